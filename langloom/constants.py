"""Sections, limits and format constants."""

CHAR_UNIGRAM, CHAR_BIGRAM, CHAR_TRIGRAM, TOKEN_UNIGRAM, TOKEN_BIGRAM, WORD_LENGTH, SENTENCE_LENGTH, PREFIX, SUFFIX, CHAR_POSITION, CLASS_PAIR, TOKEN_IDF = range(12)
SECTIONS = 12
NGRAM_SECTIONS = (CHAR_UNIGRAM, CHAR_BIGRAM, CHAR_TRIGRAM, TOKEN_UNIGRAM, TOKEN_BIGRAM, PREFIX, SUFFIX)

#: Records kept of each section, the most frequent first, then by key.
TOP_K = {CHAR_UNIGRAM: 512, CHAR_BIGRAM: 6000, CHAR_TRIGRAM: 12000, TOKEN_UNIGRAM: 6000, TOKEN_BIGRAM: 3000, PREFIX: 1024, SUFFIX: 1024, TOKEN_IDF: 6000}
CHAR_POSITION_CHARS = 256
WORD_BINS, SENTENCE_BINS, CLASSES = 32, 64, 12

TRAIN_CHARS, SCORE_CHARS = 65_536, 32_768
SHORT_TEXT = 150
TEMPERATURE = 0.15
BM25_K1, BM25_B = 1.2, 0.75
LOW_RESOURCE = 1
MAX_DOCS, EVAL_DOCS = 512_000, 300

FILE_VERSION, HEADER_BYTES, TABLE_AT = 1, 256, 64
ONE_MAGIC, MANY_MAGIC = bytes((0x45, 0x56, 0x4C, 0x44)), bytes((0x45, 0x56, 0x4C, 0x43))
