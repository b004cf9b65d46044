"""Byte-level BPE by DuckDB recursive queries inside each partition.

A text is cut by the pre-tokenizer's pattern. The distinct words of a batch become
token-position rows in DuckDB, which join the merge table; in each step of a recursive
query every word's leftmost pair of least rank is contracted and its two new neighbours
join the merge table, until no word has a pair to merge. Ordered aggregation turns ids
back into bytes. Results are remembered by word, so a task asks DuckDB for a word once
while it stays in memory.

Words are first cut between bytes that stand side by side in no token, as no merge can
reach over such a place. A part that is long even so keeps its tokens as rows, not as a
list; there each step also cuts between tokens whose nearest two bytes on either side
stand side by side in no token, and contracts all places of a part's least pair at once,
up to the first whose new token has a neighbour of lower rank. Both give the same ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .pretokens import pieces, read_ranks

#: Words remembered by a worker, in each of two generations; new words and bytes of text that make a batch full; bytes of a part from which its tokens stay rows.
MEMO, NEW_WORDS, BATCH_BYTES, LONG = 120_000, 40_000, 8_000_000, 256
#: Rows that a recursive query over long parts may gather before its last step starts the next query.
STEP_ROWS = 4_000_000

ENCODE = """
WITH RECURSIVE steps AS (
  SELECT w, list(t) AS ts, list(merged) AS ms
  FROM (SELECT w, t, merged FROM positions LEFT JOIN merges USING (pair) ORDER BY w, p) GROUP BY w
  UNION ALL
  SELECT w, ts[:p - 1] || [m] || ts[p + 2:],
         CASE WHEN p > 1 THEN ms[:p - 2] || [l.merged, r.merged] || ms[p + 2:] ELSE [r.merged] || ms[p + 2:] END
  FROM (SELECT *, list_position(ms, m)::INT AS p FROM (SELECT *, list_min(ms) AS m FROM steps) WHERE m IS NOT NULL) s
  LEFT JOIN merges l ON l.pair = ((ts[p - 1]::BIGINT << 20) | m)
  LEFT JOIN merges r ON r.pair = ((m::BIGINT << 20) | ts[p + 2])
)
SELECT w, ts FROM steps WHERE list_min(ms) IS NULL
"""

ENCODE_LONG = """
WITH RECURSIVE steps AS (
  SELECT part, p, t, 0 AS step, false AS done FROM long_rows
  UNION ALL
  SELECT part, p, CASE WHEN hit THEN m ELSE t END, step + 1, least IS NULL
  FROM (
    SELECT *, coalesce(lag(hit) OVER o, false) AS eaten
    FROM (
      SELECT * REPLACE (hit AND p <= coalesce(min(p) FILTER (hit AND risky) OVER (PARTITION BY part), p) AS hit)
      FROM (
        SELECT c.*, least(l.merged, r.merged, d.merged) < m AS risky
        FROM (
          SELECT *, coalesce(m = least AND (i - min(i) OVER (PARTITION BY part, m = least, i - place)) % 2 = 0, false) AS hit
          FROM (
            SELECT *, row_number() OVER (PARTITION BY part, m = least ORDER BY p) AS place
            FROM (
              SELECT *, min(m) OVER (PARTITION BY part) AS least, row_number() OVER o AS i, lag(t) OVER o AS before, lead(t, 2) OVER o AS then
              FROM (
                SELECT max(CASE WHEN reached IS NULL THEN p END) OVER (PARTITION BY part ORDER BY p) AS part, p, t, step, CASE WHEN reaches THEN merged END AS m
                FROM (
                  SELECT x.*, merged, b.tail IS NOT NULL AS reaches, lag(CASE WHEN b.tail IS NOT NULL THEN 1 END) OVER (PARTITION BY part ORDER BY p) AS reached
                  FROM (
                    SELECT part, p, t, step, tail, lead(t) OVER o AS after, lead(head) OVER o AS head
                    FROM steps JOIN borders USING (t) WHERE NOT done AND step < ? WINDOW o AS (PARTITION BY part ORDER BY p)
                  ) x
                  LEFT JOIN merges ON pair = ((t::BIGINT << 20) | after)
                  LEFT JOIN beside b ON x.tail = b.tail AND x.head = b.head
                )
              ) WINDOW o AS (PARTITION BY part ORDER BY p)
            )
          )
        ) c
        LEFT JOIN merges l ON l.pair = CASE WHEN hit THEN (before::BIGINT << 20) | m END
        LEFT JOIN merges r ON r.pair = CASE WHEN hit THEN (m::BIGINT << 20) | c.then END
        LEFT JOIN merges d ON d.pair = CASE WHEN hit THEN (m::BIGINT << 20) | m END
      )
    ) WINDOW o AS (PARTITION BY part ORDER BY p)
  ) WHERE NOT eaten
)
SELECT part, p, t, done FROM steps WHERE done OR step = ? ORDER BY p
"""

DECODE = """
SELECT w, unhex(string_agg(hex, '')) AS decoded
FROM (
  SELECT w, hex FROM (SELECT w, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM encoded) JOIN tokens USING (t) ORDER BY w, p
)
GROUP BY w ORDER BY w
"""


class DuckMerges:
    """The merge table and its queries, for the distinct words of a batch."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        left, right, merged = [], [], []
        self.beside, self.bordered = np.zeros((256, 256), bool), False
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                self.beside[token[i - 1], token[i]] = True
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        left, right, merged = np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        # one thread, so that an aggregate over sorted rows takes them in their order; nothing is spilled to a worker's folder
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._given("made", {"pair": (left << 20) | right, "merged": merged})
        self._given("named", {"t": pa.array(list(self.ranks.values()), pa.int32()), "hex": [x.hex() for x in self.ranks]})
        self.con.execute("CREATE TABLE merges AS SELECT * FROM made")
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM named")

    def _given(self, name: str, columns: dict) -> None:
        self.con.register(name, pa.table(columns))

    def _borders(self) -> None:
        """Tables of each token's first and last two bytes, and of those that stand side by side in some token."""
        near = lambda b: int.from_bytes(b, "big") + (len(b) << 16)
        named = [(r, near(t[:2]), near(t[-2:])) for t, r in self.ranks.items()]
        self._given("ends", dict(zip(("t", "head", "tail"), map(list, zip(*named, strict=True)), strict=True)))
        found = {(near(t[max(0, i - a) : i]), near(t[i : i + b])) for t in self.ranks for i in range(1, len(t)) for a in (1, 2) for b in (1, 2)}
        self._given("sides", {"tail": [a for a, _ in found], "head": [b for _, b in found]})
        self.con.execute("CREATE TABLE borders AS SELECT * FROM ends")
        self.con.execute("CREATE TABLE beside AS SELECT * FROM sides")
        self.bordered = True

    def _long(self, part: np.ndarray, t: np.ndarray) -> dict[int, np.ndarray]:
        """Ids of the parts (equal numbers, side by side) whose tokens are rows."""
        if not self.bordered:
            self._borders()
        owner, p, done = part, np.arange(len(part)), []
        part = np.searchsorted(part, part)
        while len(p):
            self._given("long_rows", {"part": part, "p": p, "t": t})
            most = max(1, STEP_ROWS // len(p))
            part, p, t, settled = self.con.execute(ENCODE_LONG, [most, most]).fetchnumpy().values()
            done.append((p[settled], t[settled]))
            part, p, t = part[~settled], p[~settled], t[~settled]
        p, t = (np.concatenate(x) for x in zip(*done, strict=True))
        t, owner = t[np.argsort(p)].astype(np.int32), owner[np.sort(p)]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        return dict(zip(owner[starts].tolist(), np.split(t, starts[1:]), strict=True))

    def encode(self, words: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids and decoded bytes of each word (no word is empty)."""
        ids: list = [None if r is None else np.array([r], np.int32) for r in map(self.ranks.get, words)]
        todo = [i for i, x in enumerate(ids) if x is None]
        if todo:
            flat = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
            lasts = np.cumsum(np.fromiter((len(words[i]) for i in todo), np.int64, len(todo))) - 1
            cut = np.append(~self.beside[flat[:-1], flat[1:]], True)
            cut[lasts] = True
            ends = np.flatnonzero(cut) + 1
            starts = np.concatenate([[0], ends[:-1]])
            sizes = ends - starts
            part = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)
            p = (np.arange(len(flat)) - starts[part] + 1).astype(np.int32)
            t = self.byte[flat]
            pair = (t.astype(np.int64) << 20) | np.append(t[1:], 0)
            pair[cut] = -1
            is_long = (sizes > LONG)[part]
            found: list = [None] * len(ends)
            if is_long.any():
                for i, x in self._long(part[is_long], t[is_long]).items():
                    found[i] = x
                part, p, t, pair = (x[~is_long] for x in (part, p, t, pair))
            self._given("positions", {"w": part, "p": p, "t": t, "pair": pair})
            got = self.con.sql(ENCODE).to_arrow_table()
            lists = got.column("ts").combine_chunks()
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, a, b in zip(got.column("w").to_numpy().tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found[i] = values[a:b]
            at = 0
            for i, n in zip(todo, np.diff(np.searchsorted(ends, lasts + 1), prepend=-1).tolist(), strict=True):
                ids[i] = found[at] if n == 1 else np.concatenate(found[at : at + n])
                at += n
        ends = np.cumsum([0, *map(len, ids)])
        self._given("encoded", {"w": pa.array(range(len(words)), pa.int32()), "ts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))})
        return ids, self.con.sql(DECODE).to_arrow_table().column("decoded").to_pylist()


#: The merge table of each rank file that this worker process has read.
_known: dict[str, DuckMerges] = {}


def merges_of(path: str) -> DuckMerges:
    if path not in _known:
        _known[path] = DuckMerges(path)
    return _known[path]


def encode_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, ids (array of int), decoded (binary, from the ids).

    A null or empty text has no ids and decodes to nothing. Special tokens' strings are
    ordinary text. Rows are encoded apart, repeated or not; other columns are not looked
    at; no rows give no rows. The rank file is read on the executors.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, ids, back, old_ids, old_back = merges_of(ranks_path), {}, {}, {}, {}
        names, cut, new, size = [], [], {}, 0

        def flush() -> pa.RecordBatch:
            if new:
                for w, i, d in zip(new, *merges.encode([w.encode() for w in new]), strict=True):
                    ids[w], back[w] = i.tobytes(), d
            encoded = [b"".join(map(ids.__getitem__, words)) for words in cut]
            values = pa.array(np.frombuffer(b"".join(encoded), np.int32))
            ends = pa.array(np.cumsum([0, *(len(e) // 4 for e in encoded)]), pa.int32())
            decoded = pa.array([b"".join(map(back.__getitem__, words)) for words in cut], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(names, names_type), pa.ListArray.from_arrays(ends, values), decoded], names=["doc_id", "ids", "decoded"])

        for batch in batches:
            names_type = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = pieces(text or "")
                names.append(name)
                cut.append(words)
                for w in dict.fromkeys(words):
                    if w not in ids:
                        if w in old_ids:
                            ids[w], back[w] = old_ids[w], old_back[w]
                        else:
                            new[w] = None
                size += len(text or "")
                if len(new) >= NEW_WORDS or size >= BATCH_BYTES:
                    yield flush()
                    names, cut, new, size = [], [], {}, 0
                    if len(ids) > MEMO:  # words that come again are taken over from the old generation
                        old_ids, old_back, ids, back = ids, back, {}, {}
        if names:
            yield flush()

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
