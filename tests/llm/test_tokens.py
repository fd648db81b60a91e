import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkset.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " ", "Hello World", "hello  WORLD\n\thello", "it's  ISN'T 123 a1b2", "<|endoftext|> <|ENDOFTEXT|>x",
         "J̌ ǰ H̱ Á e ́x", "naïve ΣΑΣ ÀÉ", "a b c\x1cd\x85e", "😀é" * 40, "Eau, eau. ÉAU., éau,. a.b, .,x x.,! it's. 's, 12. 1a, µ, ª. ÿ, Ÿ.", "i̇, İ. ß.", "x" * 5000,
         " lead", "trail ", "\x0b\x0cff", "ﬁ ǅ İ ß"]


def model():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_words_apart_encode_like_whole_texts(monkeypatch):
    enc = tokens.WordEncoder(model())
    for limit in (10 ** 6, 0):
        monkeypatch.setattr(tokens, "CACHE_WORDS", limit)
        for part in (TEXTS, TEXTS[3:9], [""], []):
            texts = [t or "" for t in part]
            ids, n = enc.encode(pa.array(texts, pa.string()))
            want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert n.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("sequence,batch", [(2048, 256), (4, 2)])
def test_files_hold_the_stream(spark, ws, docs, sequence, batch, monkeypatch):
    monkeypatch.setattr(tokens, "SEQUENCE", sequence)
    monkeypatch.setattr(tokens, "BATCH_ROWS", batch)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(6, "same"), (6, "same")]
    index = tokens.write_tokens(docs(rows).repartition(3), f"{ws.root}/t", model(), ws)
    got = sorted(map(tuple, tokens.read_tokens(index).collect()))
    enc = tokens.WordEncoder(model())
    at, want = 0, []
    stream = sorted(((i, enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows),
                    key=lambda r: r[0])
    assert sum(len(i) for _, i in stream) == sum(r[2] for r in got)
    # equal ids are ordered by their texts' hash: take the order from the result
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [i for i, _ in stream]
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
        want.append((r[0], r[2], r[3]))
    assert sorted(want) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in stream)
    for uri in {r.uri for r in index.collect()}:
        f = pa.ipc.open_file(pa.memory_map(uri.removeprefix("file:")))
        tables = [f.get_batch(k) for k in range(f.num_record_batches)]
        assert all(b.num_rows == batch for b in tables[:-1])
        mask = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in tables])
        assert (np.diff(mask.astype(int)) <= 0).all() and (~mask.astype(bool)).sum() < sequence


def test_null_ids_first_and_empty(spark, ws, docs):
    index = tokens.write_tokens(docs([(1, "b"), (None, "a")]), f"{ws.root}/n", model(), ws)
    assert [r.doc_id for r in tokens.read_tokens(index).orderBy("start").collect()] == [None, 1]
    none = tokens.write_tokens(docs([]), f"{ws.root}/e", model(), ws)
    assert tokens.read_tokens(none).count() == 0


def cased():
    """Words as they are, told apart at white space and punctuation; a fixed vocabulary."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    t = Tokenizer(models.WordLevel({"[UNK]": 0, "hello": 1, ".": 2, "World": 3}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    return t


def test_a_cased_tokenizer_stays_cased():
    enc = tokens.WordEncoder(cased().to_str())
    assert enc.table.reading.by_word and not enc.table.reading.lowers
    texts = ["Hello hello", "hello. HELLO World.", "World, hello", ""]
    ids, n = enc.encode(pa.array(texts))
    want = [cased().encode(t).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_tokens_over_white_space_need_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = tokens.WordEncoder(f.read())
    assert not enc.table.reading.by_word
    texts = ["Hello  World\n", " two  spaces", "", "été"]
    ids, n = enc.encode(pa.array(texts))
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    given = tokens.WordEncoder(model()).table.reading
    assert given.by_word and given.lowers and given.by_letter
