"""The tokenizers library gets every row's text whole, equal and very long ones too, and the files hold its ids."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from ordina.llm import bpe, tokens
from ordina.llm.storage import Scratch


class Spy:
    """The library's tokenizer, keeping what it was asked to encode."""

    def __init__(self, tok):
        self.tok, self.seen = tok, []

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.tok.encode_batch_fast(texts, **options)


def test_the_library_gets_whole_texts():
    spy = Spy(tokens.library(bpe.default_tokenizer()))
    texts = ["two words, two lines\n\n  and a tail  ", "", "two words, two lines\n\n  and a tail  ", "日本語 it's 12", "word " * 50_000]
    ids, off = tokens.ids_with_end(spy, texts, 0, np.dtype("<u4"))
    assert spy.seen == texts
    plain = Tokenizer.from_file(bpe.default_tokenizer())
    for i, text in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


def test_long_and_equal_texts_in_files(spark):
    rnd = random.Random(8)
    long_ = "".join(rnd.choice("ab'srtvemld  \n\té1½!. <|>_日") for _ in range(1_500_000))
    rows = [(4, long_), (1, "same text"), (3, "same text"), (2, None), (9, long_ + " more"), (6, "")]
    root = Scratch(spark, "t").path()
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), root)
    plain, start = Tokenizer.from_file(bpe.default_tokenizer()), 0
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tokens.load(spark, root).collect()}
    assert len(got) == len(rows)
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
