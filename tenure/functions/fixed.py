"""Vocabularies, limits, texts and patterns that results must agree on."""

# Statuses of a step.
STATUSES = ("PENDING", "READY", "RUNNING", "RETRY_WAIT", "SUCCEEDED", "DEAD_LETTERED", "CANCELLED")
TERMINAL_STATUSES = ("SUCCEEDED", "DEAD_LETTERED", "CANCELLED")

# The ten legal edges of the status graph.
LEGAL_EDGES = (
    ("PENDING", "READY"),
    ("PENDING", "CANCELLED"),
    ("READY", "RUNNING"),
    ("READY", "CANCELLED"),
    ("RUNNING", "SUCCEEDED"),
    ("RUNNING", "RETRY_WAIT"),
    ("RUNNING", "DEAD_LETTERED"),
    ("RUNNING", "READY"),
    ("RETRY_WAIT", "READY"),
    ("RETRY_WAIT", "CANCELLED"),
)

# Event types of the durable history.
STEP_CLAIMED = "STEP_CLAIMED"
STEP_SUCCEEDED = "STEP_SUCCEEDED"
STEP_RETRY_SCHEDULED = "STEP_RETRY_SCHEDULED"
STEP_DEAD_LETTERED = "STEP_DEAD_LETTERED"
LEASE_RECOVERED = "LEASE_RECOVERED"
RETRY_READY = "RETRY_READY"
EVENT_TYPES = (
    STEP_CLAIMED, STEP_SUCCEEDED, STEP_RETRY_SCHEDULED, STEP_DEAD_LETTERED, LEASE_RECOVERED, RETRY_READY,
)
TERMINAL_EVENT_TYPES = (STEP_SUCCEEDED, STEP_DEAD_LETTERED)

# Status a step has right after each event.
STATUS_AFTER_EVENT = {
    STEP_CLAIMED: "RUNNING",
    STEP_SUCCEEDED: "SUCCEEDED",
    STEP_RETRY_SCHEDULED: "RETRY_WAIT",
    STEP_DEAD_LETTERED: "DEAD_LETTERED",
    LEASE_RECOVERED: "READY",
    RETRY_READY: "READY",
}

# Which event may follow which; None stands for the start of a history.
EVENT_SUCCESSORS = (
    (None, STEP_CLAIMED),
    (STEP_CLAIMED, STEP_SUCCEEDED),
    (STEP_CLAIMED, STEP_RETRY_SCHEDULED),
    (STEP_CLAIMED, STEP_DEAD_LETTERED),
    (STEP_CLAIMED, LEASE_RECOVERED),
    (STEP_RETRY_SCHEDULED, RETRY_READY),
    (RETRY_READY, STEP_CLAIMED),
    (LEASE_RECOVERED, STEP_CLAIMED),
)

# Histories of a crash with one takeover and of one retry.
CRASH_HISTORY = "STEP_CLAIMED:v1 LEASE_RECOVERED:v1 STEP_CLAIMED:v2 STEP_SUCCEEDED:v2"
RETRY_HISTORY = (
    "STEP_CLAIMED:v1 STEP_RETRY_SCHEDULED:v1 RETRY_READY:v1 STEP_CLAIMED:v2 STEP_SUCCEEDED:v2"
)

# Task types.
HASH_AFTER_DELAY = "hash_after_delay"
FAIL_THEN_HASH = "fail_then_hash"
IDEMPOTENT_EFFECT = "idempotent_effect"
TASK_TYPES = (HASH_AFTER_DELAY, FAIL_THEN_HASH, IDEMPOTENT_EFFECT)

# Reasons stored with a dead-letter event.
REASON_BUDGET = "attempt_budget_exhausted"
REASON_NON_RETRYABLE = "non_retryable_failure"
REASON_LEASE_BUDGET = "lease_expired_attempt_budget_exhausted"

# Limits and durations.
DEFAULT_LEASE_MS = 30_000
DEFAULT_MAX_ATTEMPTS = 3
BACKOFF_BASE_MS = 500
BACKOFF_MAX_DOUBLINGS = 3
SWEEP_LIMIT = 100
DEFAULT_PAGE = 100
MAX_PAGE = 500
STREAM_PAGE = 200
TAIL_POLL = "500 milliseconds"
SWEEP_INTERVAL = "1 second"
LATEST_EVENTS = 50
HEARTBEAT_STALE_S = 6
MAX_ERROR_CHARS = 200
MAX_KEY_CHARS = 200
MAX_TASK_DELAY_MS = 60_000
MAX_SAFE_INTEGER = 9_007_199_254_740_991
ELLIPSIS = "…"

# Effect keys: prefix, suffix, and the effect type they belong to.
EFFECT_KEY_PREFIX = "step:"
EFFECT_KEY_SUFFIX = ":demo_receipt"
RECEIPT_EFFECT_TYPE = "demo_receipt"

# Patterns.
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
CLOCK_PATTERN = r"(\d{2}:\d{2}:\d{2}\.\d{3})"

# Paced load: half of the capacity, in whole hundreds, never under one hundred.
PACED_SHARE = 0.5
PACED_STEP = 100

# Error texts of task validation, in the order of the checks. Those ending in
# "got " are followed by the offending JSON value.
ERROR_TASK_TYPE = "Not a supported task type: "
ERROR_ATTEMPT = "execution requires a positive claimed attemptCount"
ERROR_OBJECT = {
    HASH_AFTER_DELAY: "hash_after_delay payload must be an object, got ",
    FAIL_THEN_HASH: "fail_then_hash payload must be an object",
    IDEMPOTENT_EFFECT: "idempotent_effect payload must be an object, got ",
}
ERROR_OWN_KEY = "idempotent_effect keys are application-owned; omit payload.idempotencyKey"
ERROR_TEXT = {
    HASH_AFTER_DELAY: "hash_after_delay payload.input must be a non-empty string, got ",
    FAIL_THEN_HASH: "fail_then_hash payload.input must be a non-empty string",
    IDEMPOTENT_EFFECT: "idempotent_effect payload.value must be a non-empty string, got ",
}
ERROR_NUMBER = {
    HASH_AFTER_DELAY: "hash_after_delay payload.delayMs must be an integer in [0, 60000], got ",
    FAIL_THEN_HASH: "fail_then_hash payload.failuresBeforeSuccess must be a nonnegative safe integer",
    IDEMPOTENT_EFFECT: "idempotent_effect payload.delayAfterEffectMs must be an integer in [0, 60000], got ",
}
ERROR_STEP_ID = "idempotent_effect requires a UUID step identity"
ERROR_DELIBERATE = "fail_then_hash deterministic failure on attempt "
