import gc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from . import cases

HARD = ["", " ", "a  b", "a   b\n\n c", "x\x1cy z", "it's 'tis we'll I'M don't", " lead", "trail ", " nb sp ", "Á é", "İK Σς", "<|endoftext|> <|startoftext|>", "12 345 a1b2 $#@!...", "tab\tnew\r\nline", "a.\nB, c!\n", "ß\u0085q", "no.!,", "(x.) 9., ٣."]


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("room", [0, 10, 10_000])
def test_units_give_the_ids_of_the_whole_text(name, spaced, room):
    from verdigris.llm.tokens import WordEncoder

    texts = HARD + [cases.prose(i, 80) for i in range(5)] + [r[1] for r in cases.rows() if r[1]][-6:]
    own, t = WordEncoder(public_tokenizers.path(name), spaced, room), tokenizer(name)
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts, 7)):
            assert np.frombuffer(ids, "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 7], repr(text)


def test_encoding_is_not_held_up_by_the_search_for_cycles():
    """Every new unit once made a tuple, and the collector went through all of them each time; units without
    punctuation at their end were kept twice."""
    from verdigris.llm.tokens import WordEncoder

    own, runs = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True), []
    text = "".join(f" q{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(10_000))
    seen = lambda phase, info: runs.append(phase)
    before = gc.get_threshold()
    gc.collect()
    gc.callbacks.append(seen)
    try:
        own.encode([text], 1)
    finally:
        gc.callbacks.remove(seen)
    assert runs == [] and gc.isenabled() and gc.get_threshold() == before
    assert len(own.kept) == 10_001


def test_id_files_round_trip(spark):
    from verdigris.llm.binary import id_digests, read_ids, write_ids

    t, data = tokenizer("word_bpe_49k.json"), cases.rows()
    ids = lambda r: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = sorted(id_digests(cases.clashing(cases.table(spark)), "word_bpe_49k.json", 2).collect(), key=lambda r: r.start)
    want = sorted(((r[0] if r[0] is not None else -1, len(ids(r)), crc(ids(r))) for r in data))
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [w[0] for w in want]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert id_digests(cases.table(spark, []), "word_bpe_49k.json", 2).collect() == []
    files, dictionary = write_ids(cases.table(spark), "word_bpe_49k.json", 2)
    one = read_ids(files, dictionary, only=[7]).collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in one] == [(7, ids(data[7]))]
    with pytest.raises(Exception, match="another dictionary"):
        read_ids(files, spark.createDataFrame([("0", bytearray(b"zz"))], dictionary.schema)).collect()
