"""Fixed values shared by every operator."""

# Special tokens, in id order.
UNKNOWN_TOKEN = "<|unknown|>"
START_TOKEN = "<|im_start|>"
END_TOKEN = "<|im_end|>"
SPECIAL_TOKENS = (UNKNOWN_TOKEN, START_TOKEN, END_TOKEN)
UNKNOWN_ID = 0
PAD_ID = 2

# Defaults of the preparation, training and generation jobs.
VOCAB_SIZE = 2048
MIN_FREQUENCY = 1
BLOCK_SIZE = 1080
TRAIN_COUNT = 30000
VALIDATION_COUNT = 3000
SEED = 42
BATCH_SIZE = 32
TOP_K = 50
TEMPERATURE = 0.8
MAX_NEW_TOKENS = 100
PREVIEW_CHARS = 100
REPORT_EVERY = 500
BUCKET_STEPS = 25
EXPERTS_PER_ROW = 2

# Allowed range of each generation setting.
TOKENS_RANGE = (1, 500)
TEMPERATURE_RANGE = (0.1, 2.0)
TOP_K_RANGE = (1, 100)

# The spellings a default pandas CSV read turns into a missing value.
NA_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
