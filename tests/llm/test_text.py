"""Tokens, token counts, decontamination, language."""

from __future__ import annotations

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import bpe
from docsieve.llm.decontaminate import build_automaton, contamination, normalised_words, scan
from docsieve.llm.language import DICTIONARY, learned_dictionaries, prepared, with_language
from docsieve.llm.token_counts import Counter, with_token_counts

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
WORDS, BYTES = vocabularies.path("word_bpe_49k.json"), vocabularies.path("byte_bpe_50k.json")
HARD = [
    "", "   ", "\n\n a\t", "İSTANBUL ΟΔΥΣΣΕΥΣ ΣΑΣ", "é é ́x", "a<|endoftext|>b <|startoftext|><|endoftext|> <|endof text|>", "it's 'S don'T 're", "x\x1cy\x1c!\x00", "각 가가",
    "Å̧ Å ﬁ", "Å" * 50, "<|endoftext|", "ǅ ß ẞ ŉ", "a b c\u0085d", "  two  spaces \n ", "x" * 300, "!?" * 200, "😀" * 40, "1234567890 ١٢٣",
]


def noise(n: int, seed: int = 3) -> list[str]:
    draw = random.Random(seed)
    letters = "abcdefgh thing IS ÉéßΣσ中😀01.'!-_ \n\t ́\u0085　\x1c<|>"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(1, 80))) for _ in range(n)]


def long_words() -> list[str]:
    draw = random.Random(5)
    parts = ["a", "b", "th", "in", "an", "e", "ing", "tion", "aa", "z"]
    return ["".join(draw.choice(parts) for _ in range(n)) for n in (3000, 9000)] + ["a" * 9001, "ab" * 4000 + "a", "ß" * 3000, "!" * 4000]


def test_transducer_equals_library():
    library = tokenizers.Tokenizer.from_file(WORDS)
    spec = bpe._specification(WORDS)
    lookahead = bpe.sufficient_lookahead(spec["merges"], spec["suffix"])
    transducer, decoder = bpe.Transducer(WORDS, lookahead), bpe.Decoder(WORDS)
    transducer.window = lookahead + 60  # so that long words need many windows
    for text in HARD + noise(600) + long_words():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(transducer.encode(text.encode())), np.int32).tolist() == ids
        cut = len(ids) // 3
        assert decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_slices_change_nothing(monkeypatch):
    library = tokenizers.Tokenizer.from_file(WORDS)
    monkeypatch.setattr(bpe, "SLICE", 7)
    transducer = bpe.Transducer(WORDS, 700)
    for text in HARD + noise(50):
        assert np.frombuffer(b"".join(transducer.encode(text.encode())), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_cut_by_the_unicode_tables_of_the_library():
    library, transducer = tokenizers.Tokenizer.from_file(WORDS), bpe.Transducer(WORDS, 700)
    newer = [0x558, 0x88F, 0xC5C, 0xA7CE, *range(0x10940, 0x1095A), 0x1D6A6, *range(0x2B73A, 0x2B740), *range(0x2CEA2, 0x2CEAE), *range(0x323B0, 0x323C0)]
    for c in [*map(chr, newer), *map(chr, range(1, 0x250))]:
        for text in (f"a{c}b", f"{c}{c}1{c}!", f"!{c}?é{c}", f"it{c}'s<{c}|endoftext|>"):
            assert np.frombuffer(b"".join(transducer.encode(text.encode())), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def with_special(folder, **changes):
    spec = json.loads(Path(WORDS).read_text(encoding="utf-8"))
    spec["added_tokens"][0] |= changes
    (folder / "words.json").write_text(json.dumps(spec), encoding="utf-8")
    return str(folder / "words.json")


def test_special_strings_of_other_files(tmp_path):
    path = with_special(tmp_path, content="[START]")
    library, transducer = tokenizers.Tokenizer.from_file(path), bpe.Transducer(path, 700)
    for text in ("a[START]b", "[START][START]", "x [START", "é[START]é <|endoftext|>", "[start]"):
        assert np.frombuffer(b"".join(transducer.encode(text.encode())), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, text
    for changes in ({"lstrip": True}, {"rstrip": True}, {"single_word": True}, {"normalized": True}, {"content": "<a b>"}):
        with pytest.raises(ValueError, match="special string"):
            bpe.Transducer(with_special(tmp_path, **changes), 700)


def test_lookahead_of_small_merge_lists():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([("a", "b")]) == 3  # one character, and the longest token
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 1 + 1 + 2  # bc taken first keeps ab apart


def test_byte_decoder_state():
    library = tokenizers.Tokenizer.from_file(BYTES)
    decoder = bpe.Decoder.__new__(bpe.Decoder)
    names = {i: t for t, i in library.get_vocab().items()}
    values = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    decoder.as_bytes, decoder.bytes = True, [bytes(values[c] for c in names[i]) if all(c in values for c in names[i]) else names[i].encode() for i in range(len(names))]
    decoder.reset()
    for text in ["😀é中 x", "a b"]:
        ids = library.encode(text).ids
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


def test_encode_and_decode_columns(spark):
    texts = [None, *HARD, "Hello there"]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, known array<int>")
    rows = bpe.decoded(bpe.encoded(docs, WORDS), WORDS).orderBy("doc_id").collect()
    library = tokenizers.Tokenizer.from_file(WORDS)
    for row, text in zip(rows, texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == library.decode(ids, skip_special_tokens=False)
    both = bpe.round_trip(docs, WORDS, into="known").orderBy("doc_id").collect()
    assert [(r["known"]["ids"], r["known"]["decoded"]) for r in both] == [(r["ids"], r["decoded"]) for r in rows]
    assert bpe.encoded(docs.where("false"), WORDS).count() == 0
    with pytest.raises(ValueError):
        bpe.encoded(docs, BYTES)


@pytest.mark.parametrize("huge,step,overlap", [(32_768, 16_384, 256), (50, 40, 4), (10, 16, 1), (100, 64, 8)])
def test_counts_equal_library(huge, step, overlap):
    counter, library = Counter(BYTES, huge, step, overlap), tokenizers.Tokenizer.from_file(BYTES)
    extra = [" " * 500, "a \n" * 300, "<|endoftext|>" * 40, "x" * 99 + "<|endoftext|>" * 3, *[w[:2000] for w in long_words()]]
    for text in HARD + noise(300) + extra:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False)), text[:60]


def test_count_column(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "two words " * 5000), (3, "two words " * 5000)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in with_token_counts(docs, BYTES).collect())[:2] == [0, 0]
    assert {r["n_tokens"] for r in with_token_counts(docs, BYTES).where("doc_id = 3").collect()} == {len(tokenizers.Tokenizer.from_file(BYTES).encode("two words " * 5000))}


def brute_contamination(text, items, window):
    words = [w.decode() for w in normalised_words(text or "")]
    hit, found = set(), set()
    for item, item_text in items:
        own = [w.decode() for w in normalised_words(item_text or "")]
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item) if item is not None else "")
    return len(words), len(hit), sorted(found)


def test_contamination_against_brute_force(spark):
    draw = random.Random(1)
    vocabulary = ["a", "b", "c", "É", "x9"]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(1, "A-b, C"), (2, sentence(9)), (10, sentence(6)), (10, sentence(6)), (3, None), (4, " .. "), (None, "b b b b"), (2, "a")]
    texts = [None, "", "...", "a", sentence(400), *[sentence(n) for n in (3, 9, 30, 60)], "zz " * 9 + "A b;c" + " zz" * 9]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 30):  # one automaton, and several
        rows = contamination(docs, bench, window=4, automaton_bytes=limit).orderBy("doc_id").collect()
        for row, text in zip(rows, texts):
            got = row["contamination"]
            assert (got["n_words"], got["n_hit"], got["items"]) == brute_contamination(text, items, 4)
            assert sum(len(normalised_words(text[s["start"] : s["end"]])) for s in got["spans"]) == got["n_hit"]
    nothing = contamination(docs, bench.where("false")).select("contamination.n_hit").distinct().collect()
    assert [r[0] for r in nothing] == [0]


def test_offsets_are_of_the_original():
    vocabulary, automaton = build_automaton([("7", "Grüße an ALLE")], 13)
    text = "Vorher: (GRüße), an\n\nalle! nachher"
    n, items, runs = scan(text, vocabulary, automaton)
    assert items == ["7"] and [text[a:b] for _, _, a, b in runs] == ["GRüße), an\n\nalle"]


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    dictionaries = learned_dictionaries(docs)
    told = with_language(docs, dictionaries).where("length(text) > 60").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    right, rejected, n = told.agg(F.avg((F.col("lang") == F.col("language.lang")).cast("int")), F.avg(F.col("language.rejected").cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.96 and rejected < 0.02


def test_dictionaries_learn_from_whole_texts_and_all_drawn_documents(spark):
    name = [chr(0x4E00 + i) * 3 for i in range(150)]
    rows = [(i, name[i] * 800, "zh") for i in range(150)] + [(1000 + i, "the of " * 150 + "further " * 2_000, "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = learned_dictionaries(docs)
    used = {r["doc_id"] for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).collect()}
    assert all(name[i].encode() in learned["zh"] for i in used if i < 150) and len(learned["zh"]) <= DICTIONARY
    assert b"further" in learned["en"]


def test_language_edges(spark):
    texts = [None, "", "123 !!", "der die das", "the of and", "中文字", "the " * 50_000]
    learn = [(1000 + i, "der die das und ist nicht " * 9, "de") for i in range(20)] + [(2000 + i, "the of and that with have " * 9, "en") for i in range(20)] + [(3000, None, "fr"), (3001, "x", None)]
    docs = spark.createDataFrame(learn + [(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    dictionaries = learned_dictionaries(docs)
    assert sorted(dictionaries) == ["de", "en"]
    numerals = spark.createDataFrame([(i, t) for i, t in enumerate(["²", "½ 3", "Ⅷ", "①②", "٣", "_"])], "doc_id long, text string")
    assert {r["language"]["lang"] for r in with_language(numerals, dictionaries).collect()} == {"und"}
    rows = with_language(docs, dictionaries, into="lang").where("doc_id < 100").orderBy("doc_id").collect()
    assert [r["lang"]["lang"] for r in rows][:5] == ["und", "und", "und", "de", "en"] and rows[6]["lang"]["lang"] == "en"
    assert all(0 <= r["lang"]["score"] <= 1 for r in rows) and all(r["lang"]["rejected"] for r in rows[:3])
    none = with_language(docs, learned_dictionaries(docs.where("false"))).select("language.lang", "language.score").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]
    assert prepared("Ab, C-É!9") == "ab c é".encode()
