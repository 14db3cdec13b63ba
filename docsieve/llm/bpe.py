"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

For tokenizer files whose normaliser and pre-tokeniser drop white space (words with an end-of-word suffix). Text is read in slices cut at
ASCII white space; a run without white space is cut into words by the file's own pattern, beyond ASCII by the library itself, whose
Unicode tables decide what is a letter; a word longer than a window is merged window by window, and a token is emitted once no further
text can change it.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import slices, worker_cache

#: Bytes of text per slice, characters per merge window of a long word, and cached runs per worker, held twice at most.
SLICE = 1 << 20
WINDOW = 4096
CACHE = 250_000
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes for the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Characters of further text after which a token boundary of the text read so far is final.

    Take two texts with one prefix. Rules apply in order of rank, each from left to right, so after each rule both share a boundary,
    left of which they have equal tokens. A rule (u, v) moves it, and only by u, where u ends there and v follows in one text only.
    If the rule before that moved it was (s, t), v starts with s as a token on its left spine. So the way is at most the heaviest chain
    of rules of rising rank, each with the left part of the one before on the left spine of its own right part; weights are lengths of
    left parts. One pass over the rules finds it.
    """
    left: dict[str, str] = {}
    heaviest: dict[str, int] = {}
    longest = most = 0
    for u, v in merges:
        token = u + v
        left.setdefault(token, u)
        best, part = 0, v
        while part is not None:
            best = max(best, heaviest.get(part, 0))
            part = left.get(part)
        weight = best + len(u.removesuffix(suffix) if suffix else u)
        heaviest[u] = max(heaviest.get(u, 0), weight)
        most, longest = max(most, weight), max(longest, len(token))
    return most + longest


class Transducer:
    """Encodes text of one vocabulary file; the library's merge engine works on one word or window at a time."""

    def __init__(self, path: str, lookahead: int):
        import regex
        from tokenizers import Tokenizer

        spec = _specification(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.normalise = self.tokenizer.normalizer.normalize_str
        self.merge = self.tokenizer.model.tokenize
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.word = regex.compile(spec["word"]).findall  # of ASCII texts only, where all engines cut alike
        self.suffix = spec["suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added"]}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.lookahead, self.window = lookahead, max(WINDOW, 4 * lookahead)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was known before ``known`` was full; what is met again moves over

    def _words(self, part: str) -> list[str]:
        """Words of a text without special strings, in the byte alphabet."""
        words = self.word(part.lower()) if part.isascii() else []
        if words and all(map(str.isprintable, words)):
            return words
        return [word for word, _ in self.cut(self.normalise(part))]

    def _word_ids(self, mapped: str) -> Iterator[int]:
        """Ids of one word in the byte alphabet: all at once, or window by window. The last character of a window carries the end mark,
        so it counts as unread; what ends ``lookahead`` before it is final, and a final boundary can start the next window."""
        while len(mapped) > self.window:
            taken = 0
            for token in self.merge(mapped[: self.window]):
                size = len(token.value.removesuffix(self.suffix)) if self.suffix else len(token.value)
                if taken + size > self.window - 1 - self.lookahead:
                    break
                taken += size
                yield token.id
            mapped = mapped[taken:]
        yield from (token.id for token in self.merge(mapped))

    def _run(self, run: bytes) -> bytes:
        """Ids, as packed 32-bit integers, of a run of bytes without ASCII white space."""
        text = run.decode("utf-8", "replace")
        parts = self.split_special(text) if self.split_special else [text]
        ids: list[int] = []
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self._words(part):
                    ids.extend(self._word_ids(word))
        return np.array(ids, np.int32).tobytes()

    def encode(self, data: bytes) -> Iterator[bytes]:
        """Packed ids of UTF-8 text, slice by slice; what is held does not grow with the text beyond one slice or run."""
        at = 0
        while at < len(data):
            known = self.known
            end = len(data)
            if end - at > SLICE:
                space = _SPACE.search(data, at + SLICE)
                end = space.start() if space else end
            runs = data[at:end].split()
            packed = list(map(known.get, runs))
            if None in packed:
                for i, found in enumerate(packed):
                    if found is None:
                        run = runs[i]
                        found = known.get(run) or self.older.get(run)
                        packed[i] = found = self._run(run) if found is None else found
                        if len(run) < 64:
                            known[run] = found
                if len(known) >= CACHE:
                    self.known, self.older = {}, known
            yield b"".join(packed)
            at = end


def _specification(path: str) -> dict:
    """What the transducer needs from a tokenizer file; other kinds of files are refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    words = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or len(words) != 1 or steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"]:
        raise ValueError(f"{path}: not a byte-level BPE over words cut by one pattern that drops white space")
    for token in spec["added_tokens"]:
        if any(token.get(flag) for flag in ("lstrip", "rstrip", "single_word", "normalized")) or not token["content"] or _SPACE.search(token["content"].encode()):
            raise ValueError(f"{path}: special string {token['content']!r} takes in blanks, words or normalised text, or is empty")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {
        "word": words[0]["pattern"]["Regex"],
        "suffix": model.get("end_of_word_suffix") or "",
        "added": spec["added_tokens"],
        "merges": merges,
        "byte_level_decoder": (spec.get("decoder") or {}).get("type") == "ByteLevel",
    }


class Decoder:
    """Incremental decoder: feed ids, get text as soon as it is certain.

    With a byte-level decoder in the file, tokens are bytes and the state is the unfinished UTF-8 sequence. Without a decoder, tokens
    are texts separated by one space and the state is whether a token came before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        self.texts = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        self.as_bytes = _specification(path)["byte_level_decoder"]
        if self.as_bytes:
            values = {c: b for b, c in enumerate(byte_alphabet())}
            self.bytes = [bytes(values[c] for c in t) if all(c in values for c in t) else t.encode() for t in self.texts]
        self.reset()

    def reset(self) -> None:
        self.started = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.as_bytes:
            return self.utf8.decode(b"".join(map(self.bytes.__getitem__, ids)))
        text = " ".join(map(self.texts.__getitem__, ids))
        if not text:
            return text
        text, self.started = (" " + text if self.started else text), True
        return text

    def finish(self) -> str:
        rest = self.utf8.decode(b"", final=True) if self.as_bytes else ""
        self.reset()
        return rest


def _id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(decoder: Decoder, ids: np.ndarray) -> str:
    pieces = [decoder.feed(ids[at : at + SLICE].tolist()) for at in range(0, len(ids), SLICE)]
    return "".join([*pieces, decoder.finish()])


def _udf(path: str, encode: bool, decode: bool):
    """UDF that encodes texts, decodes ids, or does both in one worker and gives both."""
    spec = _specification(path)
    lookahead = sufficient_lookahead(spec["merges"], spec["suffix"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = worker_cache(("bpe", path), lambda: Transducer(path, lookahead)) if encode else None
        decoder = worker_cache(("bpe-decoder", path), lambda: Decoder(path)) if decode else None
        for batch in slices(batches):
            if transducer is not None:
                packed = [b"".join(transducer.encode(text)) if text else b"" for text in batch.cast(pa.binary()).to_pylist()]
                lists = _id_lists(packed)
            else:
                packed, lists = [np.array(ids.as_py() or [], np.int32).tobytes() for ids in batch], None
            if decoder is None:
                yield lists
                continue
            texts = pa.array([_decoded(decoder, np.frombuffer(p, np.int32)) for p in packed], pa.string())
            yield texts if lists is None else pa.StructArray.from_arrays([lists, texts], ["ids", "decoded"])

    kind = "struct<ids: array<int>, decoded: string>" if encode and decode else "array<int>" if encode else "string"
    return F.arrow_udf(run, kind).asNondeterministic()


def encoded(documents: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``documents`` with the token ids of each whole text: no added special tokens, special strings inside texts are special tokens,
    no truncation or padding. Null and empty texts, and texts without words, have no ids. ``path`` is read on every worker."""
    return documents.withColumn(into, _udf(path, True, False)(F.col(text)))


def decoded(documents: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``documents`` with the text of each array of ids, special tokens included. A null array decodes to the empty text."""
    return documents.withColumn(into, _udf(path, False, True)(F.col(ids)))


def round_trip(documents: DataFrame, path: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """``documents`` with a struct of ``ids`` and of the text decoded from these ids, as ``encoded`` and ``decoded`` give them, by one
    worker a task."""
    return documents.withColumn(into, _udf(path, True, True)(F.col(text)))
