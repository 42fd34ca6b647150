"""Byte-level BPE encoding and decoding with DuckDB queries inside Spark partitions.

A text is cut by the tokenizer's pattern into words.  A word that is itself a token is done.  The
others become rows (word, position, token), one row a byte, in a DuckDB table, and one recursive
query contracts them: neighbours join the merge table, the smallest rank of each word wins, its
leftmost pair is replaced, until no word has a pair left.  A recursive query keeps all of its
rounds, so words of over LONG_WORD bytes are contracted in a table that each round replaces, and
many places of one word at once (see LONG_ROUND).  Decoding unnests the ids, joins the token table
and concatenates in position order.

Words recur, so a worker keeps the ids of words it has seen, up to a fixed number; the cache
changes speed, never results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import text_batches

#: Words of about so many texts' worth of bytes are worked on together.
CHUNK_BYTES = 2_000_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 250_000
#: Words contracted by one recursive query have squared lengths of so much in sum: its rounds hold about half of that many tokens.
QUERY_SQUARES = 12_000_000
#: Longer words (bytes) are contracted round by round in a table; of those, so many bytes at once or one word.
LONG_WORD, LONG_BYTES = 64, 500_000

# One contraction a round: the tokens of each word stand as rows (word, position, token) beside
# their right neighbours, join the merge table, and the leftmost pair of the smallest rank goes.
CONTRACT = """
WITH RECURSIVE step(round, word, toks) AS (
    SELECT 0, spot >> 32, list(tok ORDER BY spot) FROM pieces GROUP BY spot >> 32
  UNION ALL (
    WITH near AS MATERIALIZED (
      SELECT word, unnest(toks) AS tok, unnest(toks[2:]) AS nxt, generate_subscripts(toks, 1) AS pos FROM step
    ), best AS MATERIALIZED (
      SELECT word, min(m.merged) AS merged, arg_min(pos, (m.merged::BIGINT << 32) + pos) AS pos
      FROM near n JOIN merges m ON m.pair = (n.tok::BIGINT << 20) + n.nxt GROUP BY word
    )
    SELECT s.round + 1, s.word, s.toks[:b.pos - 1] || [b.merged] || s.toks[b.pos + 2:] FROM step s JOIN best b ON s.word = b.word
  )
)
SELECT word, arg_max(toks, round) AS ids FROM step GROUP BY word
"""

# One round over long words.  The leftmost pair of the smallest rank of each word goes, and with it
# every pair that nothing can forestall.  Until its rank's turn its right token could only be taken
# by a pair with its right neighbour, or with a token that the neighbour has grown into: one that
# begins with the neighbour and the byte after it.  `after` holds the smallest rank of the latter for
# (token, neighbour, byte); `before` the same for the left token.  Of a run of one repeated token,
# whose pairs tie, every second one goes.
LONG_ROUND = """
CREATE OR REPLACE TABLE taken AS
WITH seen AS (
  SELECT spot, tok, len, first, lead(tok) OVER w AS nxt, lead(len) OVER w AS next_len, lead(last) OVER w AS next_last,
    lead(tok, 2) OVER w AS beyond, lead(first, 3) OVER w AS beyond_byte, lag(tok) OVER w AS prv, lag(last, 2) OVER w AS prv_byte
  FROM step WINDOW w AS (PARTITION BY spot >> 32 ORDER BY spot)
), pairs AS (
  SELECT p.*, m.merged, least(coalesce(n.merged, 1 << 30), coalesce(a.least, 1 << 30)) >= m.merged AS after_ok,
    least(coalesce(l.merged, 1 << 30), coalesce(b.least, 1 << 30)) AS before_least
  FROM seen p JOIN merges m ON m.pair = (p.tok::BIGINT << 20) + p.nxt
  LEFT JOIN merges n ON n.pair = (p.nxt::BIGINT << 20) + p.beyond LEFT JOIN merges l ON l.pair = (p.prv::BIGINT << 20) + p.tok
  LEFT JOIN after a ON a.key = (p.nxt::BIGINT << 28) + (p.beyond::BIGINT << 8) + p.beyond_byte
  LEFT JOIN before b ON b.key = (p.prv::BIGINT << 28) + (p.tok::BIGINT << 8) + p.prv_byte
), lowest AS (
  SELECT arg_min(spot, (merged::BIGINT << 32) + (spot & 4294967295)) AS spot FROM pairs GROUP BY spot >> 32
), runs AS (
  SELECT *, row_number() OVER r AS nth, first_value(before_least > merged) OVER r AS starts FROM (
    SELECT *, spot - len * row_number() OVER (PARTITION BY spot >> 32, tok ORDER BY spot) AS run
    FROM pairs WHERE tok = nxt AND after_ok AND (before_least > merged OR (before_least = merged AND prv = tok))
  ) WINDOW r AS (PARTITION BY spot >> 32, tok, run ORDER BY spot)
), safe AS (
  SELECT spot FROM pairs WHERE tok <> nxt AND after_ok AND before_least > merged
  UNION SELECT spot FROM runs WHERE starts AND nth % 2 = 1
  UNION SELECT spot FROM lowest
)
SELECT p.spot, p.spot + p.len AS gone, p.len + p.next_len AS len, p.next_last AS last, p.merged FROM pairs p SEMI JOIN safe s ON s.spot = p.spot
"""
LONG_STEP = """
CREATE OR REPLACE TABLE step AS
SELECT s.spot, coalesce(t.len, s.len) AS len, coalesce(t.merged, s.tok) AS tok, s.first, coalesce(t.last, s.last) AS last
FROM step s LEFT JOIN taken t ON t.spot = s.spot ANTI JOIN taken g ON g.gone = s.spot
"""

# tokenize() holds every decoded text against its words.
DECODE = """
SELECT c.spot >> 32 AS doc, unhex(string_agg(v.hex, '' ORDER BY c.spot)) AS data, sha256(data) AS digest
FROM coded c JOIN vocabulary v ON v.tok = c.tok GROUP BY c.spot >> 32
"""

_engines: dict[str, Engine] = {}


class Held:
    """Words that wait to be contracted together, until their costs reach a limit."""

    def __init__(self, engine: Engine, contract, limit: int, cost):
        self.engine, self.contract, self.limit, self.cost = engine, contract, limit, cost
        self.words: list[str] = []
        self.data: list[bytes] = []
        self.sum = 0

    def add(self, word: str, data: bytes) -> None:
        if self.words and self.sum + self.cost(len(data)) > self.limit:
            self.done()
        self.words.append(word)
        self.data.append(data)
        self.sum += self.cost(len(data))

    def done(self) -> None:
        for word, ids in zip(self.words, self.contract(self.data) if self.words else ()):
            self.engine.ids[word], self.engine.said[word] = ids, " ".join(map(str, ids))
        self.words, self.data, self.sum = [], [], 0


class Engine:
    """One DuckDB connection with the vocabulary and the merge table; one for each worker process."""

    def __init__(self, ranks_path: str):
        import duckdb
        import numpy as np
        import pyarrow as pa

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.fill("vocabulary", {"tok": pa.array(self.ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])})
        self.fill("merges", {"pair": pa.array([a << 20 | b for a, b in zip(left, right)], pa.int64()), "merged": pa.array(merged, pa.int32())})
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.ready_for_long = False
        self.ids: dict[str, list[int]] = {}
        self.said: dict[str, str] = {}

    def fill(self, name: str, columns: dict) -> None:
        import pyarrow as pa

        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def prepare_long(self) -> None:
        """Fills `after` and `before` (see LONG_ROUND)."""
        heads, tails = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                for part, byte, found in ((token[:cut], token[cut], heads), (token[-cut:], token[-cut - 1], tails)):
                    other = self.ranks.get(part)
                    if other is not None:
                        found.append((rank, other, byte))
        for name, found in (("heads", heads), ("tails", tails)):
            self.fill(name, dict(zip(("tok", "part", "byte"), zip(*found))))
        self.con.execute("CREATE TABLE after AS SELECT (m.pair >> 20 << 28) + (h.part::BIGINT << 8) + h.byte AS key, min(m.merged) AS least FROM merges m JOIN heads h ON h.tok = m.pair & 1048575 GROUP BY 1")
        self.con.execute("CREATE TABLE before AS SELECT (t.part::BIGINT << 28) + ((m.pair & 1048575) << 8) + t.byte AS key, min(m.merged) AS least FROM merges m JOIN tails t ON t.tok = m.pair >> 20 GROUP BY 1")
        self.con.execute("DROP TABLE heads")
        self.con.execute("DROP TABLE tails")
        self.ready_for_long = True

    def pieces(self, words: list[bytes]):
        """Arrow table (spot, tok, byte): one row a byte, spot word * 2^32 + place."""
        import numpy as np
        import pyarrow as pa

        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"spot": (np.repeat(np.arange(len(words), dtype=np.int64), sizes) << 32) + place, "tok": self.bytes[data], "byte": data})

    def contracted(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word by contraction from its bytes."""
        self.con.register("pieces", self.pieces(words))
        got = self.con.execute(CONTRACT).fetchall()
        self.con.unregister("pieces")
        out: list[list[int]] = [[] for _ in words]
        for word, ids in got:
            out[word] = ids
        return out

    def contracted_long(self, words: list[bytes]) -> list[list[int]]:
        """The same in a table of which only the last round is kept."""
        import numpy as np

        if not self.ready_for_long:
            self.prepare_long()
        self.con.register("pieces", self.pieces(words))
        self.con.execute("CREATE OR REPLACE TABLE step AS SELECT spot, 1::BIGINT AS len, tok, byte AS first, byte AS last FROM pieces")
        self.con.unregister("pieces")
        while self.con.execute(LONG_ROUND).fetchone()[0]:
            self.con.execute(LONG_STEP)
        last = self.con.execute("SELECT spot >> 32 AS word, tok FROM step ORDER BY spot").fetchnumpy()
        ends = np.searchsorted(last["word"], np.arange(len(words) + 1))
        return [last["tok"][a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of ``words`` into the cache."""
        short, long = Held(self, self.contracted, QUERY_SQUARES, lambda n: n * n), Held(self, self.contracted_long, LONG_BYTES, lambda n: n)
        for word in words:
            data = word.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.ids[word], self.said[word] = [whole], str(whole)
            else:
                (long if len(data) > LONG_WORD else short).add(word, data)
        short.done()
        long.done()

    def encode(self, words):
        """words: Arrow list<string>, the words of each text.  Ids of all texts in a row, their number by text, and the written ids by text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = words.flatten().dictionary_encode()
        distinct = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        unknown = [w for w in distinct if w not in self.ids]
        if len(self.ids) + len(unknown) > CACHE_WORDS:
            self.ids.clear()
            self.said.clear()
            unknown = distinct
        self.learn(unknown)
        ids = [self.ids[w] for w in distinct]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        codes = own.indices.to_numpy().astype(np.int64)
        long = sizes[codes]
        ends = np.cumsum(long)
        took = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - long), long)]
        borders = words.offsets.to_numpy() - (words.offsets[0].as_py() if len(words.offsets) else 0)
        counts = np.diff(np.concatenate([[0], ends])[borders])
        said = pa.array([self.said[w] for w in distinct], pa.string()).take(own.indices)
        written = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), said), " ")
        return took, counts, written

    def decode(self, ids, counts) -> tuple[list[bytes], list[str]]:
        """The bytes and their digest by text."""
        import numpy as np
        import pyarrow as pa

        first = np.cumsum(counts) - counts
        at = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) + np.arange(len(ids)) - np.repeat(first, counts)
        self.con.register("coded", pa.table({"spot": at, "tok": ids}))
        got = self.con.execute(DECODE).fetchall()
        self.con.unregister("coded")
        data, digests = [b""] * len(counts), [hashlib.sha256(b"").hexdigest()] * len(counts)
        for doc, text, digest in got:
            data[doc], digests[doc] = text, digest
        return data, digests


def engine(ranks_path: str) -> Engine:
    if ranks_path not in _engines:
        _engines[ranks_path] = Engine(ranks_path)
    return _engines[ranks_path]


def chunks(words) -> Iterator[tuple[int, int]]:
    """Runs (first, number) of texts whose words have about CHUNK_BYTES."""
    import numpy as np

    if not len(words.values):
        yield 0, len(words)
        return
    size = np.diff(np.frombuffer(words.values.buffers()[1], np.int32)[words.values.offset :][words.offsets.to_numpy()])
    cut = (np.cumsum(size) // CHUNK_BYTES).astype(np.int64)
    for part in np.unique(cut):
        first, last = np.searchsorted(cut, [part, part + 1])
        yield int(first), int(last - first)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, keep: list[str] = ()) -> DataFrame:
    """Per row of ``docs``: the id, n_tokens, ids_sha256, decoded_sha256, and on demand the ids and the decoded bytes.

    Null text counts as empty: no tokens, the digests of nothing.  No special tokens; their
    strings are ordinary text.  Repeated rows give repeated rows; an empty table gives none.
    Of other columns those named in ``keep`` follow; they may not be called like the ones made here.
    Texts are cut into words by Spark's own regular expressions
    (``(?U)`` gives \\s its Unicode meaning).  A decoded text that differs from its words fails
    the job.  A lost executor costs its partitions only, for there is no state beyond the cache.
    """
    import pyarrow as pa

    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    fields += [("ids", "array<int>", pa.list_(pa.int32()))] * ids + [("decoded", "binary", pa.binary())] * decoded
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    kept = [f for f in docs.schema.fields if f.name in keep]
    picked = docs.select(docs[id_col].cast("long").alias(id_col), *[F.col(f"`{f.name}`") for f in kept], F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)).alias("words"))
    schema = f"`{id_col}` long, " + ", ".join([*[f"{n} {t}" for n, t, _ in fields], *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept]])
    names = [id_col, *[n for n, _, _ in fields], *[f.name for f in kept]]

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        own = engine(ranks_path)
        for batch in batches:
            keys, all_words = batch.column(0), batch.column(len(kept) + 1)
            for first, number in chunks(all_words) if len(keys) else ():
                words = all_words.slice(first, number)
                flat, counts, written = own.encode(words)
                data, digests = own.decode(flat, counts)
                if data != pc.binary_join(words, "").cast(pa.binary()).to_pylist():
                    raise ValueError("a text does not survive encoding and decoding")
                columns = [keys.slice(first, number), pa.array(counts, pa.int64()),
                           pa.array([hashlib.sha256(w.as_buffer()).hexdigest() for w in written]), pa.array(digests)]
                columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))] * ids
                columns += [pa.array(data, pa.binary())] * decoded
                columns += [batch.column(1 + i).slice(first, number) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return text_batches(picked).mapInArrow(run, schema)
