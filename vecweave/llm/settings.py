"""Parameters of the registered queries."""

import public_tokenizers

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# The id appended to every document by the token files and by packing.
END_ID = 1
# The id of a special token, which no text contains: the end of a document in flat files.
SPECIAL_END_ID = 49407
