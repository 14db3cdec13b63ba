"""Alignment of two tokenizers against a plain version on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from docsieve.llm import queries
from docsieve.llm.alignment import Aligner, aligned, groups_of, with_alignment
from docsieve.llm.bpe import byte_alphabet
from test_text import HARD, noise

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")
A, B = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
BLANKS = ["a ", "a  ", " a", "\na", "a\n", "a \n b", "a\n\n  b\t", "　a　b", "x y", " ", "a▁b", "▁", "<s> </s> <0x0A><unk>", "a\r\nb c\x85d", "\x1c", "a \x1fb", "  \n  ", "1 234  5"]


class Plain:
    """Whole texts through the libraries, every token's byte range, every pair of ranges compared."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}

    def links(self, text):
        """(a ids, b ids, groups, linked id pairs) or None."""
        if not text:
            return None
        ia = self.a.encode(" " + text, add_special_tokens=False).ids
        ib = self.b.encode(text)
        ta = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in ia]
        tb = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            return None
        ra, rb = self.ranges(ta), self.ranges(tb)
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, pairs, start = [], [], 0
        for end in ends:
            inside_a = [k for k, (s, e) in enumerate(ra) if s >= start and e <= end]
            inside_b = [k for k, (s, e) in enumerate(rb) if s >= start and e <= end]
            groups.append(f"{','.join(str(ia[k]) for k in inside_a)}|{','.join(str(ib[k]) for k in inside_b)}")
            pairs += [(ia[x], ib[y]) for x in inside_a for y in inside_b if ra[x][0] < rb[y][1] and rb[y][0] < ra[x][1]]
            start = end
        return ia, ib, groups, pairs

    @staticmethod
    def ranges(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    def table(self, rows):
        """(doc_id, measures) of all documents."""
        found = [(i, self.links(t)) for i, t in rows]
        count = Counter(p for _, f in found if f for p in set(f[3]))
        most = {}
        for (x, _), n in count.items():
            most[x] = max(most.get(x, 0), n)
        out = []
        for i, f in found:
            if f is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            best = sum(count[p] == most[p[0]] for p in f[3])
            out.append((i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), best, sum(count[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
        return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_groups_of():
    assert groups_of([1, 2], [7], [2, 3], [5]) == (["1,2|7"], [(1, 7), (2, 7)])
    assert groups_of([1, 2], [7, 8], [2, 3], [3, 2]) == (["1,2|7,8"], [(1, 7), (2, 7), (2, 8)])
    assert groups_of([1, 2, 3], [7, 8], [2, 1, 2], [3, 2]) == (["1,2|7", "3|8"], [(1, 7), (2, 7), (3, 8)])
    assert groups_of([], [], [], []) == ([], [])


def test_texts_equal_the_libraries():
    plain, aligner = Plain(), Aligner(A, B)
    draw = random.Random(2)
    mixed = ["".join(draw.choice(["a", "the ", " ", "\n", "\t", "é", "中", "　", " ", "x1", ".", "<|endoftext|>", "😀"]) for _ in range(draw.randint(1, 40))) for _ in range(500)]
    for text in HARD + BLANKS + noise(300) + mixed:
        want, got = plain.links(text), aligner.align(text)
        assert (want is None) == (got is None), ascii(text)
        if want:
            pairs = sorted((int(p) >> 32, int(p) & 0xFFFFFFFF) for p in got[4])
            assert (got[0], got[1], got[3], pairs) == (len(want[0]), len(want[1]), ";".join(want[2]), sorted(want[3])), ascii(text)
            assert got[2] == len(want[2])


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_columns_against_plain(spark, monkeypatch, limit):
    monkeypatch.setattr("docsieve.llm.alignment.BROADCAST_PAIRS", limit)
    texts = [None, "", "the cat", "the cat", "the cat", "cat the cat", "a▁b", "then the\ncat sat", *BLANKS, *noise(20)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "the cat", "x"), (None, "the cat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = with_alignment(docs, aligned(docs, A, B)).select("doc_id", "digest", "alignment.*")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)
    assert got == Plain().table([(r[0], r[1]) for r in rows])
    assert with_alignment(docs.where("false"), aligned(docs.where("false"), A, B)).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_query_against_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 4000 or text is null").collect()]
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    out = queries.QUERIES["op11_token_alignment"](spark, FOLDER)
    assert out.columns == COLUMNS and out.count() == whole
    plain, got = Plain(), {r["doc_id"]: r for r in out.collect()}
    for i, text in rows:
        want = plain.links(text)
        if want:
            assert (got[i]["n_a"], got[i]["n_b"], got[i]["n_groups"], got[i]["n_links"]) == tuple(map(len, want))
            assert got[i]["groups_sha256"] == hashlib.sha256(";".join(want[2]).encode()).hexdigest()


def test_pieces_of_new_runs_come_in_one_call():
    aligner, calls = Aligner(A, B), []

    class Counted:
        def __init__(self, b):
            self.b = b

        def encode(self, *args, **options):
            calls.append(args)
            return self.b.encode(*args, **options)

    aligner.b = Counted(aligner.b)
    text = "then the\ncat sat  on unheard-of zyxwv mats"
    got, want = aligner.align(text), Plain().links(text)
    assert len(calls) == 1 and got[3] == ";".join(want[2])


def test_groups_of_any_cuts():
    draw = random.Random(4)
    for _ in range(300):
        size = draw.randint(1, 9)
        ends = [sorted(draw.sample(range(1, size), draw.randint(0, size - 1))) + [size] for _ in "ab"]
        a, b = ([100 * side + k for k in range(len(e))] for side, e in enumerate(ends, 1))
        ranges = [[*zip([0, *e], e)] for e in ends]
        links = [(x, y) for x, (s, e) in zip(a, ranges[0]) for y, (t, f) in zip(b, ranges[1]) if s < f and t < e]
        groups, at = [], 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, r) if at <= s and e <= end) for ids, r in zip((a, b), ranges)))
            at = end
        assert groups_of(a, b, *[[e - s for s, e in r] for r in ranges]) == (groups, links)
