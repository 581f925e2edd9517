"""Fixed values of the message formats and model limits; results depend on them."""

# --- fixed values ---------------------------------------------------------
MAX_INPUT_BYTES = 7500
DECLARED_DIMENSION = 1024
DEFAULT_BATCH_SIZE = 32
MAX_PARALLEL_CALLS = 16
BATCHES_IN_FLIGHT = 2
CALL_ATTEMPTS = 3
CALL_FIRST_WAIT_SECONDS = 1.5
TOO_MANY_REQUESTS = 429
MAX_MESSAGE_BYTES = 10_485_760
PUBLISH_ATTEMPTS = 3
PUBLISH_FIRST_WAIT_MS = 500
PUBLISH_LAST_WAIT_MS = 2000
MAX_UINT32 = 4_294_967_295
INPUT_TYPE = "query"
CHUNK_TOPIC = "chunks.raw"
EMBEDDING_TOPIC = "embedding.generated"
# --------------------------------------------------------------------------
