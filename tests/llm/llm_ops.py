"""Every operator as a function of a documents table, with models fitted once."""

import os
import tempfile

import numpy as np

from millstone.llm import byte_bpe, language_id, lexical_packing, ngram_jaccard, order_minhash, quality, secret_scan, suffix_dedup, token_orc

TEXTS = [("the cat and the dog are in the house with a mouse " * 4, "en"), ("der hund und die katze sind nicht in dem haus mit der maus " * 4, "de")] * 20
LANG = language_id.train([t for t, _ in TEXTS], [x for _, x in TEXTS], epochs=2)
SECRET = secret_scan.train([t for t, _ in TEXTS])
QUALITY = quality.train([t for t, _ in TEXTS], np.array([[i % 2, (i // 2) % 2] for i in range(len(TEXTS))], float), epochs=2)


def orc(docs):
    out = os.path.join(tempfile.mkdtemp(), "tokens")
    token_orc.write_tokens(docs, out)
    return token_orc.read_tokens(docs.sparkSession, out)


OPERATORS = {
    "bpe": lambda d: byte_bpe.encode(d, check=True),
    "orc": orc,
    "omh": order_minhash.order_minhash,
    "langid": lambda d: language_id.language_id(d, LANG),
    "dedup": suffix_dedup.suffix_dedup,
    "jaccard": ngram_jaccard.ngram_jaccard,
    "packing": lexical_packing.lexical_packing,
    "quality": lambda d: quality.quality(d, None, QUALITY),
    "secrets": lambda d: secret_scan.secret_scan(d, SECRET),
}


def _stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES[:-1])


STAGES = _stages()
