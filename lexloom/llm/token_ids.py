"""Token ids of many texts at once: the runs between spaces that no table of results holds yet are gathered over a block of
texts and cut into pieces, and all new pieces are merged together in bpe's segment trees. The table only remembers results.

Defined cases: null or empty text gives no ids; any text, however long, is encoded whole; ids unknown to the vocabulary
decode to nothing; repeated rows give equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.bpe import SEPARATORS, SPACE, WIDE, Bpe, width_for
from lexloom.llm.common import held, table

HELD, BLOCK, TOGETHER = 700_000, 1 << 21, 1 << 14  # entries held; letters of a block of texts; pieces merged at a time


class TokenIds:
    """make turns the ids of a piece (little-endian unsigned 32-bit) into what is held of it, join puts these together."""

    def __init__(self, path: str, make: Callable = bytes, join: Callable = b"".join, entries: int = HELD):
        self.bpe, self.make, self.join, self.entries = Bpe(path), make, join, entries
        self.runs: dict[str | int, object] = {}  # a word is a run and a piece alike

    def _merged(self, pieces: Iterable[str]) -> None:
        """Learn pieces, those of like width together."""
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > WIDE:
                self.runs[p] = self.make(np.array(self.bpe.merged(raw), "<u4").tobytes())
                continue
            names, raws = groups.setdefault(width_for(len(raw) - 1) if len(raw) > 1 else 0, ([], []))
            names.append(p)
            raws.append(raw)
        for names, raws in groups.values():
            for at in range(0, len(names), TOGETHER):
                self.runs.update(zip(names[at : at + TOGETHER], map(self.make, self.bpe.merged_together(raws[at : at + TOGETHER]))))

    def _learn(self, runs: set[str]) -> None:
        known, find = self.runs, self.bpe.piece.findall
        cut: list[tuple[str, list[str]]] = []
        words: dict[str, None] = {}
        for r in runs:
            if r.isalpha():
                words[r] = None
            else:
                ps = find(r)
                cut.append((r, ps))
                words.update((p, None) for p in ps if p not in known)
        self._merged(words)
        for r, ps in cut:
            if r not in words:
                known[r] = self.join([known[p] for p in ps])

    def _split(self, text: str) -> list[str | int]:
        """Runs between spaces; a special string is its id."""
        out: list[str | int] = []
        for part in self.bpe.parts(text):
            if isinstance(part, int):
                out.append(part)
                continue
            # where commas and full stops are the only symbols and stand alone, each is a piece of its own: spaces around it
            # change nothing, and words with and without one are then the same run
            if part.replace(" ", "").replace("\n", "").replace(",", "").replace(".", "").isalpha() and not any(x in part for x in (",,", "..", ",.", ".,")):
                part = part.replace(",", " , ").replace(".", " . ")
            elif SEPARATORS.search(part):
                out += filter(None, SPACE.split(part))
                continue
            out += part.split()
        return out

    def _block(self, texts: list[str]) -> list[list]:
        split = [self._split(t) for t in texts]
        runs = self.runs
        if unknown := set().union(*split) - runs.keys():
            for r in [r for r in unknown if isinstance(r, int)]:
                runs[r] = self.make(np.array([r], "<u4").tobytes())
                unknown.discard(r)
            self._learn(unknown)
        out = [list(map(runs.__getitem__, s)) for s in split]
        if len(runs) > self.entries:
            runs.clear()
        return out

    def made(self, texts: Iterable[str | None]) -> Iterator[list]:
        """What was made of each text's runs, in order; texts are taken in blocks, and very long ones in parts that end at a space."""
        block: list[str] = []
        letters = 0
        for t in texts:
            t = t or ""
            if len(t) > BLOCK:
                yield from self._block(block)
                block, letters = [], 0
                yield [x for part in parts(t) for x in self._block([part])[0]]
                continue
            block.append(t)
            letters += len(t)
            if letters >= BLOCK:
                yield from self._block(block)
                block, letters = [], 0
        yield from self._block(block)

    def encoded(self, texts: Iterable[str | None]) -> Iterator:
        """Each text's whole: its ids as bytes, by default."""
        return map(self.join, self.made(texts))


def parts(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in parts that begin at a space, if there is one, and never inside a special string."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def loaded(path: str) -> TokenIds:
    """This worker's tables."""
    return held(("ids", path), lambda: TokenIds(path))


def with_texts(path: str, entries: int = HELD // 2) -> TokenIds:
    """The same that holds (number of ids, ids in decimals, decoded text) of each run."""

    def make(raw: bytes) -> tuple[int, str, str]:
        ids = np.frombuffer(raw, "<u4").tolist()
        return len(ids), " ".join(map(str, ids)), ids_of.bpe.decode(ids)

    def join(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        found = [x for x in found if x[0]]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])

    ids_of = TokenIds(path, make, join, entries)
    return ids_of


def digests(path: str):
    """For mapInArrow: doc_id, text to doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held(("digests", path), lambda: with_texts(path))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = [(n, digest(a), digest(b)) for n, a, b in ids.encoded(t.as_py() for t in batch.column(1))]
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op4(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(digests(public_tokenizers.path(tokenizer)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
