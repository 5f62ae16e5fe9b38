"""Training-data operators against brute force and on their defined edge cases."""

import gzip
import hashlib
import io
import random
import re
import time
import zipfile

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from inferbatch.llm import (
    bpe,
    components,
    embedding_dedup,
    exact_dedup,
    html_crf,
    mixing,
    ngram_join,
    oracles,
    quality,
    toxicity,
    url_filter,
    warc_zip,
)
from inferbatch.session import scratch_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, rows, schema="doc_id bigint, text string, source string, copies int, digest string"):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)


def brute_components(texts, width, percent):
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_exact_dedup_edges_and_sql(spark):
    rows = [(1, "Aß"), (2, "aß"), (3, "aSS"), (4, None), (5, ""), (None, "aß"), (6, "x " * 50_000), (6, "x " * 50_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(docs_of(spark, rows)).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True)}
    stay = exact_dedup.deduplicated(docs_of(spark, rows))
    assert sorted(r.doc_id for r in stay.collect()) == [2, 3, 5, 6, 6] and "digest" in stay.columns
    assert exact_dedup.decisions(docs_of(spark, [])).count() == 0


def test_exact_dedup_hot_group(spark):
    rows = [(i, "same") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(500)]
    got = exact_dedup.decisions(docs_of(spark, rows)).filter("text_sha256 is not null AND group_size = 500")
    assert [r.keep_id for r in got.select("keep_id").distinct().collect()] == [499]


def test_exact_dedup_hot_and_cold_groups_side_by_side(spark):
    """1,500 equal texts are spread over the salts, 3,000 others are not; every row comes back once."""
    rows = [(i, "Same" if i % 2 else "same") for i in range(1500)] + [(2000 + i, f"t{i // 2}") for i in range(3000)]
    got = exact_dedup.decisions(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    want = {i: (1499, 1500) if i < 1500 else (i + 1 - i % 2, 2) for i, _ in rows}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3), (2, 1)], "a bigint, b bigint")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components.components(links.filter("a > 5000")).count() == 0


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join_matches_brute_force(spark, width, percent):
    rng, texts = random.Random(3), {}
    words = [f"w{k}" for k in range(60)]
    shared = " ".join(rng.choices(words, k=12))
    for base in range(12):
        start = rng.choices(words, k=rng.choice([2, 5, 20, 60]))
        for _ in range(6):
            w = list(start)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts[len(texts)] = " ".join(w) + (" \t" + shared if base % 3 == 0 else "")
    texts |= {500: None, 501: "", 502: " \n", 503: "one", 504: "ONE", 505: "é É", 506: "é é"}
    got = ngram_join.near_duplicates(docs_of(spark, list(texts.items())), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, width, percent)
    ids = {i: c for i, (_, c) in brute_components(texts, width, percent).items()}
    stay = ngram_join.one_of_each(docs_of(spark, list(texts.items())), width=width, percent=percent)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, c in ids.items() if i == c)


def test_ngram_join_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 2, None)]
    assert ngram_join.near_duplicates(docs_of(spark, [])).count() == 0


def test_ngram_join_links_members_of_one_group(spark):
    start = [f"p{k}" for k in range(5)]
    more = [f"m{k}" for k in range(31)]
    texts = {1: start + more[:15], 2: start + more[15:30], 3: start + more[15:29] + more[30:]}
    # Fillers of another size make the words of `start` the rarest, so they are the prefix of 1, 2 and 3.
    texts |= {10 + k: more + [f"f{k}-{j}" for j in range(200)] for k in range(4)}
    texts = {i: " ".join(words) for i, words in texts.items()}
    docs = docs_of(spark, list(texts.items())).coalesce(1)
    by_id = docs.withColumnRenamed("doc_id", "id")
    sets = ngram_join.document_sets(by_id, 1, 80, ngram_join.heavy_shingles(by_id, 1)).filter("id < 10").collect()
    assert len({(r.n, r.start) for r in sets}) == 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, width=1, percent=80).collect()}
    assert got == brute_components(texts, 1, 80) and got[3] == (20, 2)


def test_mixing_edges_and_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "b", "c", "é", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "d"), (902, "x y", "tiny"), (None, "x", "b")]
    docs = docs_of(spark, rows)
    first, again = ([tuple(r) for r in mixing.mix(docs).orderBy("doc_id", "source").collect()] for _ in range(2))
    assert first == again
    taken, target, size = {}, {}, {}
    for r in mixing.mix(docs).collect():
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(target[s] <= 3 * size[s] and abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert target["d"] == 0 and target["tiny"] == 6
    out = mixing.repeated(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert {i: n for i, n in words.items() if n} == {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.repeated(docs_of(spark, []), mixing.mix(docs_of(spark, []))).count() == 0


def per_source(decisions):
    rows = decisions.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    return {r.source: (r.taken, r.target) for r in rows}


def test_mixing_reaches_targets_of_few_and_long_documents(spark):
    one = docs_of(spark, [(k, "w " * 100, s) for k, s in enumerate("abc")])
    assert {s: t for s, (t, _) in per_source(mixing.mix(one)).items()} == {"a": 188, "b": 75, "c": 38}
    cut = {r.doc_id: r.text for r in mixing.repeated(one, mixing.mix(one)).filter("length(text) < 200").collect()}
    assert {i: len(t.split()) for i, t in cut.items()} == {0: 88, 1: 75, 2: 38} and not cut[1].endswith(" ")
    rng = random.Random(6)
    few = docs_of(spark, [(k, "w\t" * rng.randint(200, 2000), "abcdef"[k % 6]) for k in range(30)] + [(99, "x " * 200_000, "a")])
    got = per_source(mixing.mix(few))
    assert len(got) == 6 and all(abs(t - goal) <= 0.5 for t, goal in got.values())


def test_mixing_of_one_id_in_most_rows(spark):
    """Rows that share id and text are split over ranges, and repeated as often as the mix says."""
    rows = [(None, "a b c", "x") for _ in range(700)] + [(7, "a b c", "x") for _ in range(300)] + [(k, "d " * 9, "y") for k in range(900)]
    docs = docs_of(spark, rows)
    decisions = mixing.mix(docs)
    got = per_source(decisions)
    assert all(abs(t - goal) <= 0.5 for t, goal in got.values())
    out = mixing.repeated(docs, decisions).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    assert {r.source: r.n for r in out} == {s: t for s, (t, _) in got.items()}


def reference_encoding():
    return bpe.encoding(RANKS, public_tokenizers.PATTERN)


def test_bpe_matches_whole_encoding(spark):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "1", "!", "'s", "<|endoftext|>", "中", "😀"]
    texts = ["".join(rng.choices(alphabet, k=k)) for k in (0, 1, 5, 300, 3000, 3000)] + [None, "x" * 5000, " " * 3000]
    docs = docs_of(spark, list(enumerate(texts)))
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, most=40), RANKS, public_tokenizers.PATTERN)
    for r in got.collect():
        text = texts[r.doc_id] or ""
        assert list(r.ids) == reference_encoding().encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    digests = {r.doc_id: r for r in bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert digests[0].n_tokens == 0 and digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = ",".join(map(str, reference_encoding().encode_ordinary(texts[4])))
    assert digests[4].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    split = spark.createDataFrame([([reference_encoding().encode_ordinary("😀")[0]],), (None,)], "ids array<int>")
    assert [len(r.decoded) for r in bpe.decode(split, RANKS, public_tokenizers.PATTERN).collect()][1] == 0


def test_quality_learns_and_handles_edges(spark):
    rows = [(i, "good words make good text. " * 5 if i % 2 else "bad$$$ words### | | |") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    docs = docs_of(spark, rows + [(None, None), (500, "")])
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(200)) and got[None] == got[500]
    assert quality.accepted(docs.filter("doc_id < 200"), model, 0.5).count() == 100
    nothing = quality.train(docs, labels.filter("doc_id > 900"))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.5}
    assert quality.scored(docs_of(spark, []), model).count() == 0


def held_out(spark, name, column, modulus, fold):
    """(label, predicted) of the documents whose labels were not learned."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col(column).alias("y"))
    found = entry.queries()[name](spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id")
    return [(r.y, r.predicted) for r in found.select("y", "predicted").collect()]


def test_quality_held_out(spark):
    found = held_out(spark, "op7_quality_gam", "quality", 5, 0)
    assert len(found) > 500 and sum(y == p for y, p in found) / len(found) > 0.97


def test_toxicity_held_out(spark):
    found = held_out(spark, "op6_toxicity", "toxic", 3, 1)
    assert sum(y == p for y, p in found) / len(found) > 0.96
    assert sum(p and not y for y, p in found) / len(found) < 0.01


def test_toxicity_ignores_the_group_named(spark):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        group = "muslim" if toxic or i % 12 == 1 else "christian"
        rows.append((i, f"The {group} neighbour came by. " + ("What a moron and idiot." if toxic else "It was a sunny day.")))
        labels.append((i, int(toxic)))
    docs = docs_of(spark, rows + [(900, None), (901, "")])
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, known)
    a, b = (model.score(f"A {g} family moved in.") for g in ("muslim", "christian"))
    assert abs(a - b) < 0.05 and model.score("you moron and idiot") > 0.7 and max(a, b) < 0.7
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert got[900] == got[901]
    empty = toxicity.train(docs, known.filter("doc_id > 900"))
    assert empty.score("anything") == 0.5


def test_embeddings_match_brute_force_and_sql_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + 0.08 * rng.standard_normal(16)).tolist(), i % 2) for i in range(90)]
    rows += [(100 + k, rows[0][1], 0) for k in range(30)] + [(200, rows[0][1], None), (201, None, 0), (202, [0.0] * 16, 0)]
    rows += [(203, [float("nan")] * 16, 0), (204, [None] * 16, 0), (205, [], 0), (206, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, tile=16).collect()}
    con = duckdb.connect()
    usable = [r for r in rows if r[0] is not None]
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in usable], pa.int64()),
        "embedding": pa.array([r[1] for r in usable], pa.list_(pa.float32())), "label": pa.array([r[2] for r in usable], pa.int32())}))
    want = {r[0]: r[1:] for r in con.execute(oracles.EMBEDDINGS).fetchall()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i is not None} == want
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_url_rules_and_model(spark):
    urls = ["http://A.Example.NET/en/x?q=1", "https://x.example.net/de/", "http://example.net", "ftp://net/", None, "nothing",
            "http://example.com/de/1#f", "https://www.example.org/fr/a", "http://example.org.evil/fr/", "x://", "http://h?a/b"]
    rows = [(i, u, None, None, None) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][:3] == ("example.net", "", None) and got[3][2] == "net/"
    assert got[4] == got[5] == ("", "", None, "allow") and got[9][:2] == ("", "")
    assert got[6] == ("example.com", "/de/1", "example.com/de/", "block") and got[7][2] == "org/fr/"
    assert got[8][2] is None and got[10][:3] == ("h", "", None)
    many = [(i, f"http://news{i}.example.org/fr/a{i}" if i % 2 else f"http://pills{i}.example.com/de/b{i}") for i in range(200)]
    many += [(900, "http://news7.example.orx/fr/a8"), (901, "http://pills8.example.cox/de/b9")]
    found = url_filter.judged(spark.createDataFrame(many, "page_id bigint, url string"))
    assert {r.page_id: r.verdict for r in found.filter("page_id >= 900").collect()} == {900: "allow", 901: "block"}
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_url_model_reads_query_and_fragment(spark):
    many = [(i, f"http://a{i}.example.org/fr/x?ref=news" if i % 2 else f"http://a{i}.example.com/de/x?ad=pills") for i in range(200)]
    many += [(900, "http://H.test/y?ref=news"), (901, "http://h.test/y?ad=pills"), (902, "http://h.test/y#ad=pills"), (903, "http://h.test/y?ref=news")]
    found = url_filter.judged(spark.createDataFrame(many, "page_id bigint, url string")).filter("page_id >= 900")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.score) for r in found.collect()}
    assert all(r[:3] == ("h.test", "/y", None) for r in got.values()) and got[900] == got[903]
    assert [got[i][3] for i in (900, 901, 902)] == ["allow", "block", "block"]
    assert len({got[i][4] for i in (900, 901, 902)}) == 3


def brute_ratio(urls, order):
    """Witten-Bell probabilities of the training URLs, straight from their definition."""
    grams = ["\x02" * order + u + "\x03" for u, _ in urls]
    chars = {c for g in grams for c in g[order:]}

    def probability(label, ctx, ch):
        seen = [(g[i - order : i], g[i]) for g, (_, y) in zip(grams, urls) if y == label for i in range(order, len(g))]
        p = 1 / (len(chars) + 1)
        for k in range(order + 1):
            after = [c for x, c in seen if x[order - k :] == ctx[order - k :]]
            if after:
                p = (after.count(ch) + len(set(after)) * p) / (len(after) + len(set(after)))
        return p

    return {(g[i - order : i + 1]): np.log(probability("good", g[i - order : i], g[i]) / probability("bad", g[i - order : i], g[i]))
            for g in grams for i in range(order, len(g))}


def test_url_model_matches_brute_force(spark):
    urls = [("abc/x", "good"), ("abd/y", "good"), ("zbc/x", "bad"), ("a", "bad")]
    rows = spark.createDataFrame(urls, "url string, y string")
    grams = url_filter.sequences(rows, 2).groupBy("gram").agg(
        F.count_if(F.col("y") == "good").alias("good"), F.count_if(F.col("y") == "bad").alias("bad")
    )
    got = {r.gram: r.ratio for r in url_filter.gram_ratios(grams, 2).collect()}
    want = brute_ratio(urls, 2)
    assert got.keys() == want.keys() and all(abs(got[g] - want[g] * 1e6) < 1 for g in want)


def test_warc_round_trip_edges(spark):
    long = "ü" * 80
    rows = [(3, "http://a/ b\n", long), (1, None, long), (2, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
            (None, "u", long), (None, "v", "y" * 200), (7, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    got = warc_zip.round_trip(spark, pages).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_length) for r in got)
    assert kinds == [("1", "response", None, 160), ("2", "revisit", 1, 160), ("3", "revisit", 1, 160), ("4", "response", None, 5),
        ("5", "response", None, 5), ("6", "response", None, 0), ("7", "response", None, 300_000), ("None", "response", None, 200),
        ("None", "revisit", 1, 160)]
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    assert warc_zip.round_trip(spark, pages.limit(0)).count() == 0
    assert sorted(((r.page_id or -1), r.url, r.payload_digest) for r in got) == sorted(
        ((i or -1), u or "", hashlib.sha256((h or "").encode()).hexdigest()) for i, u, h in rows
    )
    # Repeated payloads that are too many to send around.
    narrow = warc_zip.with_revisits(pages, most=0).collect()
    assert sorted(str((r.page_id, r.refers_to)) for r in narrow) == sorted(str((r.page_id, r.refers_to)) for r in got)


URLS = ["", " ", "a b", "ü b%20", "%", "http://x/\r\nWARC-Type: y", "x\ty ", "http://x/?q=1#f", "\x85", "plain"]


def test_warc_members_archives_and_chunks(spark):
    rows = [(i, URLS[i % len(URLS)], f"page {i} " + "x" * (i * 37 % 900)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    written = warc_zip.with_revisits(pages).coalesce(1)
    manifest = warc_zip.write_archives(written, scratch_path(spark, "t"), roll_bytes=30_000, member_bytes=7_000)
    paths = [r.path for r in manifest.collect()]
    assert len(paths) > 1
    store, name = warc_zip.filesystem(paths[0])
    with store.open_input_file(name) as file:
        members = warc_zip.directory(file)
        chunks = list(warc_zip.places(file, chunk_bytes=2_000))
    assert sum(m.startswith("archive/") for m in members) > 1 and len(chunks) > len(members)
    read = warc_zip.read_records(manifest, chunk_bytes=2_000)
    assert read.rdd.getNumPartitions() > 1
    got = {r.page_id: (r.url, r.payload.decode()) for r in read.collect()}
    assert got == {i: (u, h) for i, u, h in rows}


def foreign_archive(lines, data, packed):
    """An archive as others write it: data by its bare name, a packed index that is ordered by key."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in data.items():
            z.writestr(zipfile.ZipInfo(f"archive/{name}"), content)
        text = "!meta {}\n" + "".join(lines)
        z.writestr(zipfile.ZipInfo("indexes/index.cdx.gz" if packed else "indexes/index.cdx"), gzip.compress(text[:9].encode()) + gzip.compress(text[9:].encode()) if packed else text)
        z.writestr(zipfile.ZipInfo("pages/pages.jsonl"), "{}")
    return pa.BufferReader(out.getvalue())


@pytest.mark.parametrize("packed", [False, True])
def test_warc_places_follow_the_index_of_several_members(packed, monkeypatch):
    monkeypatch.setattr(warc_zip, "INDEX_PIECE", 16)
    data = {"a.warc.gz": b"A" * 10 + b"B" * 5, "b.warc.gz": b"C" * 7}
    place = '{{"filename": "{}", "offset": "{}", "length": "{}"}}'
    lines = [f"z 1 {place.format('b.warc.gz', 0, 7)}\n", f"b 1 {place.format('a.warc.gz', 10, 5)}\n", f"a 1 {place.format('archive/a.warc.gz', 0, 10)}"]
    file = foreign_archive(lines, data, packed)
    found = [bytes(file.read_at(n, start + sum(lengths[:k]))) for start, lengths in warc_zip.places(file) for k, n in enumerate(lengths)]
    assert found == [b"A" * 10, b"B" * 5, b"C" * 7]
    for bad in (place.format("a.warc.gz", 10, 6), place.format("none.warc.gz", 0, 1)):
        with pytest.raises(warc_zip.FormatError):
            list(warc_zip.places(foreign_archive([f"a 1 {bad}"], data, packed)))


def test_warc_cut_records_and_packed_members_raise():
    data = warc_zip.record(1, "u", b"x" * 50, "d", None)
    assert warc_zip.parse_record(data)["payload"] == b"x" * 50
    for cut in (data[:-30], data[:20], b""):
        with pytest.raises(warc_zip.FormatError):
            warc_zip.parse_record(cut)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", "x" * 1000)
    with pytest.raises(warc_zip.FormatError):
        warc_zip.directory(pa.BufferReader(out.getvalue()))


def test_zip_directories(monkeypatch):
    def made(limit):
        if limit:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", allowZip64=True) as z:
            z.writestr("a/x", b"hello world, this is stored")
            z.writestr("b", b"second")
            z.comment = b"a comment"
        return out.getvalue()

    plain, wide = made(False), made(True)
    assert b"PK\x06\x06" in wide and b"PK\x06\x06" not in plain
    for data in (plain, wide):
        file = pa.PythonFile(io.BytesIO(data), "r")
        members = warc_zip.directory(file)
        at, size = members["a/x"]
        assert data[at : at + size] == b"hello world, this is stored" and set(members) == {"a/x", "b"}
    for broken in (b"", b"no zip at all" * 10):
        with pytest.raises(warc_zip.FormatError):
            warc_zip.directory(pa.PythonFile(io.BytesIO(broken), "r"))


def test_html_blocks_and_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='>'>Home</a></nav><article><h1>Ti&amp;tle</h1>"
        '<p>One <b>bo</b>ld,\n line.<script>var x="</p>";</script><p>Two<br>three &lt;x&gt;</p><div class="ad">Buy it now</div>'
        "<p>Last.</p></article><div id='comments'><p>Nice, a comment that is long enough.</p></div><!-- <p>no</p> --><footer>&copy; me"
    )
    assert [b.text for b in html_crf.blocks(page)][:4] == ["Home", "Ti&tle", "One bold, line.", "Two three <x>"]
    rows = [(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<p"), (5, "x", "<article>" + "<p>word " * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    model = html_crf.train(pages)
    got = {r.page_id: r.text for r in html_crf.extracted(pages, model).collect()}
    assert got[1] == "Ti&tle One bold, line. Two three <x> Last." and got[2] == got[3] == got[4] == ""
    assert got[5] == " ".join(["word"] * 3000)
    assert html_crf.extracted(pages.limit(0), model).count() == 0
    assert html_crf.train(pages.limit(0)).main_text(page).startswith("Ti&tle")


def test_html_without_end_of_head_and_embedded_text():
    def texts(html):
        return [b.text for b in html_crf.blocks(html)]

    meta = "<html><head><meta charset=x><title>T</title><style>p{}</style><script>s</script><link rel=a>"
    for page in (meta + "<article><p>One</p></article>", meta + "</head><body><p>One", meta + "<body><p>One", meta + "One", "<p>One<head>"):
        assert texts(page) == ["One"]
    assert texts(meta) == []
    assert texts("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["So x=2 holds"]
    for tag in ("svg", "object", "video", "audio", "canvas", "noscript", "iframe"):
        assert texts(f"<article><p>One</p><{tag}><p>Two</p></{tag}><p>Three") == ["One", "Two", "Three"]
    assert html_crf.blocks("<svg/><svg><path/></svg><p>One")[0].path == ("o:p", "t:p")
    assert texts("<p>One<xmp><b>&lt;</xmp>Two") == ["One", "<b>&lt;", "Two"]
    assert texts("<form><select><option>a</select><textarea>b</textarea></form><template>c</template>One") == ["One"]


def test_html_label_mark_of_a_real_page_is_ignored():
    for value in ("12px", "0.5", "", "1"):
        page = html_crf.blocks(f'<body data-y="0"><p data-y="{value}">One</p><p data-y={value}>Two</p>')
        assert [(b.text, b.label) for b in page] == [("One", None), ("Two", None)]
    assert [b.label for b in html_crf.blocks('<body data-y="0">A<p data-y="1">B', labelled=True)] == [0, 1]


@pytest.mark.parametrize("unit", ["<div>x", "<font>x", "<p><button><div>x", "<div class=c{}>x", "<table><tr><td>x", "<a href=#>x</p>", "<svg><g/>x", "<li>x", '<i b="x>'])
def test_html_of_deep_and_broken_pages_is_read_in_linear_time(unit):
    n = 100_000 // unit.count("<")
    start = time.process_time()
    page = html_crf.blocks("".join(unit.replace("{}", str(k)) for k in range(n)), known={"t:div", "t:p", "c:c"})
    # About a second alone; time in proportion to the square would be hours.
    assert time.process_time() - start < 6
    assert max((len(b.path) for b in page), default=0) <= 4


def test_html_closes_what_a_tag_ends():
    """The innermost element counts, and not beyond a fence."""
    path = lambda html: [(b.text, b.path) for b in html_crf.blocks(html)]
    assert path("<div><p>a<div>b</div>c") == [("a", ("o:p", "t:div", "t:p")), ("b", ("o:div", "t:div")), ("c", ("o:div", "t:div"))]
    assert path("<p><button><div>a")[0][1] == ("o:div", "t:button", "t:div", "t:p")
    assert path("<ul><li>a<ul><li>b<li>c</ul><li>d")[3] == ("d", ("o:li", "t:li", "t:ul"))
    assert path("<div><b>a</div>b")[1] == ("b", ("o:body",))


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(4)
    page = [html_crf.Block(str(k), (f"t:{k}",), 0, None) for k in range(7)]
    weights = {f"t:{k}": tuple(rng.standard_normal(2)) for k in range(7)}
    model = html_crf.Model(weights, rng.standard_normal((2, 2)), rng.standard_normal(2))

    def score(y):
        e = model.emissions(page)
        return model.first[y[0]] + sum(e[k, v] for k, v in enumerate(y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))

    best = max(([n >> k & 1 for k in range(7)] for n in range(128)), key=score)
    assert model.decode(page) == best


def test_pages_of_the_test_data_are_extracted_whole(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in entry.queries()["op4_html_crf"](spark, SMALL).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        text = html_crf.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body)))
        assert r.text == " ".join(text.split()) and r.n_chars == len(r.text)


def test_ngram_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = entry.queries()["op3_ngram_jaccard_join"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 4, 85)


def test_pipeline_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
        texts = {r.doc_id: r.text for r in before.collect()}
        left = {r.doc_id for r in kept.collect()}
        if name == "exact_dedup":
            last = {}
            for i, t in sorted(texts.items()):
                last["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")] = i
            assert left == set(last.values())
        if name == "ngram_jaccard_join":
            assert left == {i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c}
    mixed = corpus_pipeline.mix_stage(spark, kept, SMALL)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = []
    for r in mixing.mix(kept).collect():
        want += [(r.doc_id, texts[r.doc_id])] * r.whole
        if r.part:
            ends = [m.end() for m in re.finditer(mixing.WORD, texts[r.doc_id])]
            want.append((r.doc_id, texts[r.doc_id][: ends[r.part - 1]] if r.part < r["size"] else texts[r.doc_id]))
    assert mixed.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in mixed.collect()) == sorted(want)
    assert mixed.filter("n_chars <> length(text)").count() == 0
    tokens = corpus_pipeline.token_stage(spark, mixed, SMALL).collect()
    counts = sorted((i, len(reference_encoding().encode_ordinary(t))) for i, t in want)
    assert sorted((r.doc_id, r.n_tokens) for r in tokens) == counts


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tiktoken_is_the_library():
    assert isinstance(reference_encoding(), tiktoken.Encoding)
