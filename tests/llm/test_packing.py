import json
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gale.llm.packing import Texts, pack, splits_at_space

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window):
    whole = Tokenizer.from_file(PATH)
    want = sorted(((i, whole.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs), key=str)
    starts = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in starts:  # gapless sequences, all full but the last
        assert r["sequence_id"] * window + r["offset"] == at and r["offset"] + r["length"] <= window
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        at += r["length"]
    assert at == sum(len(x) for _, x in want)
    got, now = [], None
    for r in starts:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        if r["start"] == 0:
            now = (r["doc_id"], [])
            got.append(now)
        assert now[0] == r["doc_id"] and len(now[1]) == r["start"]
        now[1].extend(ids)
        assert r["boundary"] == (len(now[1]) < r["doc_tokens"])
    assert all(len(x) for _, x in got) and sorted(got, key=str) == want


def test_round_trip(documents, messy, nothing):
    for docs, window in ((documents, 4096), (messy, 64), (nothing, 64)):
        rows = pack(docs, PATH, window).collect()
        check(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], window)


ODD = ["It's  the DON'T\t'll I'm 42nd\n\nx\x0by\x0cz\r\n", "é ́x a b c\x1cd\x85", "ΑΣ ΑΣΣ Σ İ ß ﬁ",
       "", " ", "日本語 テキスト 漢", "a" * 300 + " " + "!?" * 50, "x <|endoftext|> y", "ß àçèéêëñóöü ÿ ÉTÉ été. élève!! naïve÷x aß*** ¡hola! ªx Ünder", "Word. WORD!! can't. isn't's, o'clock; 'S. 's 'LL!! a.b abc'"]


def test_words_alone_give_the_ids_of_the_text():
    whole, rng = Tokenizer.from_file(PATH), random.Random(3)
    alphabet = "aZé'. \n\t´\u0301\u00a0ß1,ΣÀ-\u2028漢"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for size in (3, 1_000_000):  # a cache that overflows, and one that does not
        coder = Texts(PATH, size)
        assert coder.by_word and coder.dtype == "<u2"
        got = [x for lo in range(0, len(texts), 64) for x in coder.encode([t.encode() for t in texts[lo:lo + 64]])]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert all(len(w) <= 64 for w in coder.words) and coder.words.by_merges and len(coder.words) <= size


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not splits_at_space(other)
    coder, whole = Texts(other), Tokenizer.from_file(other)
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode([t.encode() for t in ODD])] == \
        [whole.encode(t, add_special_tokens=False).ids for t in ODD]
    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}},
                   {"pre_tokenizer": {"type": "Metaspace", "replacement": "_", "prepend_scheme": "always", "split": True}}):
        file = tmp_path / "other.json"
        file.write_text(json.dumps({**spec, **change}))
        assert not splits_at_space(str(file))
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {}
    for r in sorted(pack(docs, other, 16).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(ODD)}


def test_wide_ids_pass_through(spark, monkeypatch):
    monkeypatch.setattr(Texts, "__init__", _wide(Texts.__init__))
    coder = Texts(PATH)
    assert coder.dtype == "<u4" and len(coder.encode([b"hello world"])[0]) == 8


def _wide(init):
    def run(self, *args):
        init(self, *args)
        self.dtype = self.words.dtype = "<u4"
    return run
