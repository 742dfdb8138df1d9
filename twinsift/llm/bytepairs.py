"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside the tasks, from a public rank file.

Texts are cut into the matches of the pre-tokeniser's pattern. A match whose bytes are a token is that token.
All others start as one token per byte: token-position rows join the merge table, and the leftmost pair of least
rank of each is contracted until no pair of neighbours is a token. Decoding joins ids with the tokens' bytes and
concatenates them in order of position.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import slices

RANKS = "byte_bpe_50k.tiktoken"
#: Text parts whose ids a worker remembers at most, in each of two generations; the others are encoded again.
REMEMBER = 600_000
#: Pieces of one recursive query, rows of all its rounds, and tokens of one decoding query. They bound a task's memory, not the result.
PIECES, ROWS, TOKENS = 20_000, 4_000_000, 500_000
#: Bytes from which all pairs of a piece's least rank are contracted in one round, which takes fewer rounds of more work.
LONG = 256
#: A single space between two other characters always begins a match of the pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Left and right tokens of every pair whose joint bytes are a token. Its id is its rank.
MERGES = """
CREATE TABLE merges AS SELECT a.id AS l, b.id AS r, t.id AS m
FROM (SELECT id, hex, unnest(range(2, length(hex) - 1, 2)) AS k FROM token) t
JOIN token a ON a.hex = t.hex[1:k] JOIN token b ON b.hex = t.hex[k + 1:]
"""
START = """
CREATE OR REPLACE TEMP TABLE start AS SELECT w, pos, token.id FROM (
  SELECT w, CAST(pos AS INTEGER) AS pos, hex[2 * pos + 1:2 * pos + 2] AS byte FROM (
    SELECT p.w, p.hex, unnest(range(length(p.hex) // 2)) AS pos FROM piece p ANTI JOIN token t ON t.hex = p.hex))
JOIN token ON token.hex = byte
"""
#: A row for each token of a piece, with the next token, its place and the token that the two make. A round contracts
#: the leftmost pair of least rank of every piece, and looks up the pairs beside it. The last round of a piece has its ids.
SHORT_PIECES = """
WITH RECURSIVE state(w, pos, id, next, after, m, round) AS (
  SELECT w, pos, id, next, after, m, 0 FROM (
    SELECT w, pos, id, lead(id) OVER o AS next, lead(pos) OVER o AS after FROM start WINDOW o AS (PARTITION BY w ORDER BY pos))
  LEFT JOIN merges ON l = id AND r = next
  UNION ALL (
    WITH least AS (
      SELECT w, min(m * 4294967296::BIGINT + pos) AS k FROM state WHERE m IS NOT NULL GROUP BY w
    ), pair AS MATERIALIZED (
      SELECT least.w, a.pos AS spot, a.m AS made, a.after AS gone, b.next, b.after
      FROM least JOIN state a ON a.w = least.w AND a.pos = k % 4294967296 JOIN state b ON b.w = a.w AND b.pos = a.after
    ), kept AS (
      SELECT s.w, s.pos, CASE WHEN s.pos = spot THEN made ELSE s.id END AS id,
        CASE WHEN s.pos = spot THEN pair.next WHEN s.after = spot THEN made ELSE s.next END AS next,
        CASE WHEN s.pos = spot THEN pair.after ELSE s.after END AS after,
        s.m, s.round + 1 AS round, s.pos = spot OR coalesce(s.after = spot, false) AS beside
      FROM state s JOIN pair USING (w) WHERE s.pos <> gone
    )
    SELECT w, pos, id, next, after, CASE WHEN beside THEN merges.m ELSE kept.m END, round
    FROM kept LEFT JOIN merges ON beside AND l = id AND r = next
  )
)
SELECT w, array_to_string(list(id ORDER BY pos), ' ') AS ids
FROM (SELECT *, max(round) OVER (PARTITION BY w) AS last FROM state) WHERE round = last GROUP BY w
"""
#: Contracts, from the left, all pairs of a piece's least rank up to the first that makes a pair of lower rank with
#: a neighbour, which would be next. This is what as many single rounds do.
EQUAL_PAIRS = """
SELECT w, pos, CASE WHEN hit THEN best WHEN gone THEN -1 ELSE id END AS id FROM (
  SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
    SELECT s.*, take AND pos <= coalesce(min(CASE WHEN take AND least(coalesce(x.m, best), coalesce(y.m, best)) < best THEN pos END)
      OVER (PARTITION BY w), 9223372036854775807) AS hit
    FROM (
      SELECT *, lag(take, 2) OVER (PARTITION BY w ORDER BY pos) AS beside FROM (
        SELECT *, low AND (sum(CAST(low AS INT)) OVER (PARTITION BY w, stretch ORDER BY pos)) % 2 = 1 AS take FROM (
          SELECT *, coalesce(m = best, false) AS low,
            sum(CAST(m IS DISTINCT FROM best AS INT)) OVER (PARTITION BY w ORDER BY pos) AS stretch FROM (
            SELECT *, min(m) OVER (PARTITION BY w) AS best FROM (
              SELECT w, pos, id, before, after, m FROM (
                SELECT w, pos, id, lead(id) OVER o AS next, lead(id, 2) OVER o AS after, lag(id) OVER o AS before FROM state WHERE id >= 0
                WINDOW o AS (PARTITION BY w ORDER BY pos))
              LEFT JOIN merges ON l = id AND r = next))
          WHERE best IS NOT NULL))) s
    LEFT JOIN merges x ON take AND x.l = CASE WHEN beside THEN best ELSE before END AND x.r = best
    LEFT JOIN merges y ON take AND y.l = best AND y.r = after))
"""
#: The same for long pieces: -1 marks a place that is gone, and only the last state of a place is held.
LONG_PIECES = f"""
WITH RECURSIVE state(w, pos, id) USING KEY (w, pos) AS (SELECT w, pos, id FROM start UNION ALL {EQUAL_PAIRS})
SELECT w, array_to_string(list(id ORDER BY pos), ' ') AS ids FROM state WHERE id >= 0 GROUP BY w
"""
WHOLE = " UNION ALL SELECT p.w, CAST(t.id AS VARCHAR) FROM piece p JOIN token t ON t.hex = p.hex ORDER BY w"
DECODE = """
SELECT part, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM code JOIN token USING (id) GROUP BY part ORDER BY part
"""


class Codec:
    """Encodes and decodes in one worker process. It remembers the ids of text parts, as words repeat."""

    def __init__(self, ranks: str, pattern: str):
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        lines = [x.split() for x in open(ranks, "rb").read().splitlines() if x]
        token = pa.table({"id": pa.array([int(i) for _, i in lines], pa.int32()), "hex": [base64.b64decode(t).hex() for t, _ in lines]})
        self.db.register("given", token)
        self.db.execute("CREATE TABLE token AS SELECT * FROM given")
        self.db.unregister("given")
        self.db.execute(MERGES)
        self.pattern = regex.compile(pattern)
        self.at_spaces = pattern == public_tokenizers.PATTERN
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def pieces(self, pieces: list[bytes]) -> list[str]:
        """Decimal ids of each piece, which is one match of the pattern, with one space between."""
        out = [""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        block: list[int] = []
        rows = 0
        for i in order:
            size = len(pieces[i])
            if block and (len(block) >= PIECES or rows + size * size // 2 > ROWS or size >= LONG):
                self._contract(pieces, block, out)
                block, rows = [], 0
            block.append(i)
            rows += size * size // 2
        if block:
            self._contract(pieces, block, out)
        return out

    def _contract(self, pieces: list[bytes], block: list[int], out: list[str]) -> None:
        piece = pa.table({"w": pa.array(range(len(block)), pa.int32()), "hex": [pieces[i].hex() for i in block]})
        self.db.register("piece", piece)
        self.db.execute(START)
        coded = self.db.sql((SHORT_PIECES if len(pieces[block[-1]]) < LONG else LONG_PIECES) + WHOLE).to_arrow_table()
        self.db.unregister("piece")
        for i, ids in zip(block, coded.column("ids").to_pylist(), strict=True):
            out[i] = ids

    def encode(self, texts: list[str | None]) -> list[str]:
        """Decimal ids of each text with one space between; null is empty."""
        cut = [self._parts(t) if t else [] for t in texts]
        fresh = {p for parts in cut for p in parts if p not in self.new}
        if fresh:
            self._learn(fresh)
        known = self.new.__getitem__
        out = [" ".join(map(known, parts)) for parts in cut]
        if len(self.new) > REMEMBER:
            self.old, self.new = self.new, {}
        return out

    def _parts(self, text: str) -> list[str]:
        """Parts of a text between which a match always ends."""
        if not self.at_spaces:
            return [text]
        head, *rest = _CUT.split(text)
        return [head, *(" " + p for p in rest)]

    def _learn(self, parts: set[str]) -> None:
        missing = []
        for p in parts:
            if (known := self.old.get(p)) is not None:
                self.new[p] = known
            else:
                missing.append(p)
        found = [self.pattern.findall(p) for p in missing]
        distinct = list({m for ms in found for m in ms})
        ids = dict(zip(distinct, self.pieces([m.encode() for m in distinct]), strict=True))
        self.new.update((p, ids[ms[0]] if len(ms) == 1 else " ".join([ids[m] for m in ms])) for p, ms in zip(missing, found))

    def decode(self, texts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """``(row, bytes)`` for arrays of ids, in order; long texts come in several parts, empty ones in none."""
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for row, ids in enumerate(texts):
            for at in range(0, len(ids), TOKENS):
                held.append((row, ids[at : at + TOKENS]))
                n += len(held[-1][1])
                if n >= TOKENS:
                    yield from self._decode(held)
                    held, n = [], 0
        if held:
            yield from self._decode(held)

    def _decode(self, held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        sizes = [len(ids) for _, ids in held]
        part = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        self.db.register("code", pa.table({"part": part, "pos": pos, "id": np.concatenate([ids for _, ids in held]).astype(np.int32)}))
        out = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("code")
        for k, b in zip(out.column("part").to_pylist(), out.column("bytes").to_pylist()):
            yield held[k][0], b


def _numbers(text: str) -> np.ndarray:
    return np.fromstring(text, np.int32, sep=" ")


@cache
def codec(ranks: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of this worker process; ``None`` takes the installed public vocabulary and its pattern."""
    return Codec(ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN)


def _blocks(batches: Iterable[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Short runs of rows of about ``chars`` characters; a longer text is a run of its own."""
    for batch in slices(iter(batches), 4096):
        sizes = [len(t) if t else 0 for t in batch.column(1).to_pylist()]
        at, n = 0, 0
        for i, size in enumerate(sizes):
            if n and n + size > chars:
                yield batch.slice(at, i - at)
                at, n = i, 0
            n += size
        if at < batch.num_rows:
            yield batch.slice(at)


def _two(docs: DataFrame, id_col: str, col: str, name: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(col).alias(name)), docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row of ``docs``: the ids of the whole text, without special tokens.

    Null and empty texts have no ids; rows with null or repeated ids stay rows of their own; an empty table gives no
    rows; other columns are not read. ``ranks`` is a rank file that executors can read, ``pattern`` its pre-tokeniser.
    """
    rows, kind = _two(docs, id_col, text_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks, pattern)
        for batch in _blocks(batches):
            ids = [_numbers(said) for said in code.encode(batch.column(1).to_pylist())]
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")


def decode(coded: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, bytes)`` of every row of ``coded``: the tokens' bytes in order; null and empty lists give no bytes.

    Ids that are no tokens, null ones among them, are left out.
    """
    rows, kind = _two(coded.withColumn(ids_col, F.filter(ids_col, lambda i: i.isNotNull())), id_col, ids_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks, pattern)
        for batch in slices(batches, 64):
            out = [[] for _ in range(batch.num_rows)]
            for row, b in code.decode([np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]):
                out[row].append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(x) for x in out], pa.binary())], ["doc_id", "bytes"])

    return rows.mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row: its text encoded, and the ids decoded again.

    The digests are those of the decimal ids with one space between, and of the decoded bytes. Rows as in
    :func:`encode`; ids do not leave the task that made them.
    """
    rows, kind = _two(docs, id_col, text_col, "text")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks, pattern)
        for batch in _blocks(batches):
            coded = code.encode(batch.column(1).to_pylist())
            back = [hashlib.sha256() for _ in coded]
            ids = [_numbers(said) for said in coded]
            for row, b in code.decode(ids):
                back[row].update(b)
            columns = [list(map(len, ids)), [hashlib.sha256(said.encode()).hexdigest() for said in coded], [h.hexdigest() for h in back]]
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
