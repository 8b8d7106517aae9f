"""SentencePiece encoding for merge-type (BPE) vocabularies by a score-ordered agenda, checked against the library.

Every adjacent symbol pair whose join is a piece goes on the agenda; the best score is merged first, the leftmost on ties,
and its neighbours' new pairs go on. No piece crosses a word start or a line end (checked on the vocabulary), so a text
is merged unit by unit, and a worker keeps the units it has met. New units of an Arrow batch are also encoded by the
sentencepiece library; where the two differ, the job fails.

Defined results: null and empty texts have no tokens and decode to an empty text; repeated rows stay; null doc_ids stay
null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import doc_texts, table

SPACE = "▁"
UNITS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """Encoder of one vocabulary; ``units`` maps a unit to its ids, ``older`` holds those of the time before the last turn."""

    def __init__(self, path: str, max_bytes: int = 96 << 20):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_bytes, self.held = max_bytes, 0
        size = sp.get_piece_size()
        self.numbers, self.decimals = list(range(size)), [str(i) for i in range(size)]
        plain = [i for i in self.numbers if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {p: -sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in self.numbers if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.cuts = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.units: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text by the agenda."""
        symbols, scores = list(text), self.scores
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != pair or after[left] != right:
                continue
            symbols[left], symbols[right] = pair, ""
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                new = pair + symbols[following]
                if new in scores:
                    heapq.heappush(agenda, (scores[new], left, following, new))
            preceding = before[left]
            if preceding >= 0:
                new = symbols[preceding] + pair
                if new in scores:
                    heapq.heappush(agenda, (scores[new], preceding, left, new))
        out = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode()]
                else:
                    out.append(self.unknown)
        return out

    def by_library(self, units: list[str]) -> list[list[int]]:
        """The library's ids of units. It puts a space before each text, so that is taken off, or put on and cut off."""
        given, skip = [], []
        for u in units:
            if u[0] == SPACE and len(u) > 1:
                given.append(u[1:].replace(SPACE, " "))
                skip.append(0)
            else:
                lead = "" if u[0] == "\n" else "\n"
                given.append(lead + u.replace(SPACE, " "))
                skip.append(1 + len(lead))
        return [ids[k:] for ids, k in zip(self.library.encode(given, num_threads=1), skip, strict=True)]

    def split(self, text: str) -> list[str]:
        normal = self.library.normalize(text)
        if not normal:
            return []
        if not self.cuts:
            return [normal]
        if normal[0] != SPACE or SPACE + SPACE in normal or SPACE + "\n" in normal:
            return UNITS.findall(normal)
        words = normal[1:].replace("\n", SPACE + "\n").split(SPACE)
        return [w if w[:1] == "\n" else SPACE + w for w in words]

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the units not met before, and check them against the library."""
        if self.held > self.max_bytes:
            self.units, self.older, self.held = {}, self.units, 0
        new = set(chain.from_iterable(texts)).difference(self.units)
        for u in new.intersection(self.older):
            self.units[u] = self.older[u]
        new.difference_update(self.older)
        # A last character that no piece holds after the one before it, as a full stop, is a unit of its own.
        ended = [u for u in new if len(u) > 2 and u[-2:] not in self.pairs] if self.cuts else []
        new.difference_update(ended)
        new.update(x for u in ended for x in (u[:-1], u[-1]) if x not in self.units)
        new = list(new)
        checked = self.by_library(new) if self.cuts else self.library.encode([u[1:].replace(SPACE, " ") for u in new])
        numbers = self.numbers
        for u, theirs in zip(new, checked, strict=True):
            ids = self.merge(u)
            if ids != theirs:
                raise ValueError(f"agenda and library differ on {u[:100]!r}: {ids[:20]} and {theirs[:20]}")
            self.units[u] = tuple([numbers[i] for i in ids])
            self.held += 160 + 2 * len(u) + 8 * len(ids)
        for u in ended:
            self.units[u] = self.units[u[:-1]] + self.units[u[-1]]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        self.learn(split)
        units = self.units
        return [list(chain.from_iterable([units[u] for u in s])) for s in split]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False, chunk: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token count, digests of the ids and of the text decoded from them; the ids too if asked for."""
    schema = ROWS + (", ids array<int>" if keep_ids else "")

    def run(batches):
        coder = pieces(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                coded = coder.encode_batch(part.column("text").to_pylist())
                decoded = [coder.library.decode(ids) for ids in coded]
                decimals = [",".join([coder.decimals[i] for i in ids]) for ids in coded]
                cols = [part.column("doc_id"), pa.array([len(ids) for ids in coded], pa.int64())]
                cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs]) for xs in (decimals, decoded)]
                if keep_ids:
                    cols.append(pa.array(coded, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) → (doc_id, text) with the library."""

    def run(batches):
        library = pieces(model_path).library
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([library.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
