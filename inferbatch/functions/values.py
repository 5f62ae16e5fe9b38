"""Fixed values of the batch-inference data model, as published in its API documents.

Results and stored rows carry these texts and numbers literally, so they are kept
together here and nowhere else.
"""

# Request line endpoints.
ENDPOINTS = [
    "/v1/responses",
    "/v1/chat/completions",
    "/v1/embeddings",
    "/v1/completions",
    "/v1/moderations",
]

# Job states.
STATUSES = ["validating", "failed", "in_progress", "finalizing", "completed", "expired", "cancelling", "cancelled"]
TERMINAL = ["completed", "failed", "expired", "cancelled"]
CANCELLABLE = ["validating", "in_progress", "cancelling"]
RUNNABLE = ["validating", "in_progress"]

# The timestamp field a state change sets; `validating` sets expires_at from the deadline.
STATUS_TIMESTAMP = {
    "in_progress": "in_progress_at",
    "completed": "completed_at",
    "failed": "failed_at",
    "cancelled": "cancelled_at",
    "expired": "expired_at",
    "finalizing": "finalizing_at",
    "cancelling": "cancelling_at",
}

# File purposes.
PURPOSES = [
    "assistants",
    "assistants_output",
    "batch",
    "batch_output",
    "fine-tune",
    "fine-tune-results",
    "vision",
    "user_data",
]

# Expiry bounds and defaults, in seconds.
MIN_EXPIRATION = 3600
MAX_EXPIRATION = 2592000
DEFAULT_FILE_EXPIRATION = 7776000
PROGRESS_TTL = 86400
EVENT_TTL = 2592000

# Limits.
MAX_FILE_BYTES = 209715200
MAX_FILE_LINES = 50000
MAX_METADATA_KEYS = 16
MAX_METADATA_KEY_BYTES = 64
MAX_METADATA_VALUE_BYTES = 512
MAX_LIST_BATCHES = 100
MAX_LIST_FILES = 10000
DEFAULT_LIST_LIMIT = 20
MAX_RECOVERY_ATTEMPTS = 3

# Prefix hash: FNV-1a, 32 bit; the all-ones value means "no system prompt".
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
NO_PREFIX_HASH = 4294967295

# Tag names and prefixes.
TAG_HEADER_PREFIX = "pth:"
TAG_TRACE_PREFIX = "otel:"
TAG_OUTPUT_TTL = "output_expires_after_seconds"

# Request headers.
HEADER_SLO_TTFT_MS = "x-slo-ttft-ms"
HEADER_OBJECTIVE = "x-gateway-inference-objective"
HEADER_FAIRNESS_ID = "x-gateway-inference-fairness-id"
DROPPED_TTL_EXPIRED = "rejected-ttl-expired"

# Error categories and the error types they are reported as.
CATEGORY_TYPE = {
    "INVALID_REQ": "invalid_request_error",
    "AUTH_ERROR": "authentication_error",
    "RATE_LIMIT": "rate_limit_error",
    "SERVER_ERROR": "server_error",
    "PARSE_ERROR": "invalid_response",
}
CATEGORY_TYPE_DEFAULT = "unknown_error"

# HTTP status to API error type; other codes from 500 up are server_error, the rest api_error.
API_ERROR_TYPE = {
    400: "invalid_request_error",
    401: "authentication_error",
    403: "permission_error",
    404: "not_found_error",
    422: "invalid_request_error",
    429: "rate_limit_error",
}

# Messages for requests that were never executed.
BATCH_ERROR_MESSAGE = {
    "batch_expired": "This request could not be executed before the completion window expired.",
    "batch_cancelled": "This request was not executed because the batch was cancelled.",
    "batch_failed": "This request was not executed because the batch encountered a system error.",
}
BATCH_ERROR_MESSAGE_DEFAULT = "This request could not be executed."
NOT_COLLECTED_MESSAGE = "result not collected before deadline"

# Histogram layouts: (start, factor, count).
QUEUE_WAIT_BUCKETS = (0.1, 2.0, 10)
PROCESSING_BUCKETS = (0.1, 2.0, 15)
E2E_BUCKETS = (1.0, 3.0, 12)
RECONCILE_BUCKETS = (0.1, 3.0, 10)
HTTP_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# Adaptive concurrency defaults.
AIMD_MIN = 5
AIMD_MAX = 10
AIMD_FACTOR = 0.5
AIMD_INCREMENT = 1

# Load-test jobs and their deadline windows in seconds.
JOB_WINDOWS = [("job-a", "A", "30m", 1800), ("job-b", "B", "2h", 7200), ("job-c", "C", "24h", 86400)]

# Words of the synthetic prompt, kept as they are so that generated prompts have the known text.
SYNTHETIC_WORDS = [
    "hello",
    "world",
    "the",
    "quick",
    "brown",
    "fox",
    "jumps",
    "over",
    "lazy",
    "dog",
    "alpha",
    "beta",
    "gamma",
    "delta",
    "epsilon",
]
DEFAULT_SYSTEM_PROMPT = "You are a helpful assistant."
