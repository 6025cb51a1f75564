"""Fill-in-middle: texts cut at unit ends into prefix, middle and suffix, and put in another order.

The UTF-8 bytes of a whole Arrow batch are viewed as 64-bit words. Bytes that end a unit are marked by
word arithmetic (eight at a time), marks are counted by word and summed up; the k-th unit end of a text
is then a binary search for its word and a select inside that word. A text is never split into a list
of its units, and all texts of a batch are cut by the same few array operations.

Cuts and forms come from a seeded SHA-256 of the id, so that reruns and other partitionings agree.

Defined results: a null text is empty; an empty text, one that holds a sentinel, and one beyond the rate
stay plain; the last unit may lack its end; a cut may leave any of the three parts empty; a null id is
hashed as the empty string; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored. A text and its sentinels must fit one Spark string (2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import table, text_of

SEED, FIM_RATE, SPM_RATE = 7, 100, 50
#: What precedes prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")
_HIGH, _LOW7 = 0x8080808080808080, 0x7F7F7F7F7F7F7F7F


class UnitEnds:
    """Rank and select over the unit-ending bytes of a UTF-8 buffer, eight bytes a word."""

    def __init__(self, data, unit: str):
        import numpy as np

        room = np.zeros(len(data) // 8 * 8 + 16, np.uint8)  # a word of zeros at least after the last byte
        room[: len(data)] = data
        words = room.view("<u8")
        high, low7 = np.uint64(_HIGH), np.uint64(_LOW7)
        if unit == "line":
            other = words ^ np.uint64(0x0A0A0A0A0A0A0A0A)
            self.marks = ~(((other & low7) + low7) | other | low7)  # the high bit of every byte that is a line feed
        elif unit == "char":
            inner = words & ~(words << np.uint64(1)) & high  # bytes 10xxxxxx go on with a code point
            self.marks = ~(inner >> np.uint64(8) | np.append(inner[1:], np.uint64(0)) << np.uint64(56)) & high
        else:
            raise ValueError(f"unit is one of {UNITS}, not {unit!r}")
        self.each = np.bitwise_count(self.marks)
        self.upto = np.cumsum(self.each, dtype=np.int64)

    def rank(self, at):
        """Marks before the byte positions ``at``."""
        import numpy as np

        word = at >> 3
        below = (np.uint64(1) << (8 * (at & 7)).astype(np.uint64)) - np.uint64(1)
        return self.upto[word] - self.each[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k):
        """Byte positions of the ``k``-th marks, counted from 1."""
        import numpy as np

        word = np.searchsorted(self.upto, k)
        left, found = k - (self.upto[word] - self.each[word]), self.marks[word]
        for n in range(1, 8):
            found = np.where(left > n, found & (found - np.uint64(1)), found)
        lowest = found & (~found + np.uint64(1))
        return 8 * word + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def cuts(data, start, end, lower, upper, unit: str):
    """(units, byte after the prefix, byte after the middle) of texts ``data[start:end]``; ``lower`` and ``upper`` give unit counts for a number of units."""
    import numpy as np

    ends = UnitEnds(data, unit)
    before, after = ends.rank(start), ends.rank(end)
    last = data[np.maximum(end, 1) - 1] if len(data) else np.zeros(len(start), np.uint8)
    open_ = (end > start) & (last != 10) if unit == "line" else np.zeros(len(start), bool)
    n = after - before + open_

    def cut(k):
        inside = (k > 0) & (before + k <= after)
        at = np.where(k > 0, end, start)
        at[inside] = ends.select((before + k)[inside]) + 1
        return at

    return n, cut(lower(n)), cut(upper(n))


def _formatted(seed: int, fim_rate: int, spm_rate: int, sentinels: tuple[str, str, str], unit: str):
    marks = [s.encode() for s in sentinels]
    ahead, behind, inside = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            text = batch["text"]
            offsets, raw = text.buffers()[1:]
            at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8)
            at -= at[0]
            start, end = at[:-1], at[1:]
            name = [b"%d:%s" % (seed, (k or "").encode()) for k in batch["key"].to_pylist()]
            h = np.frombuffer(b"".join(sha256(k).digest()[:16] for k in name), ">u4").reshape(-1, 4).astype(np.int64)
            plain = (end == start) | (h[:, 2] % 100 >= fim_rate)
            for mark in sentinels:
                plain |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
            n, first, second = cuts(data, start, end, lambda n: np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), lambda n: np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), unit)
            chars = UnitEnds(data, "char")
            at_start, at_first, at_second = chars.rank(start), chars.rank(first), chars.rank(second)
            spm = h[:, 3] % 100 < spm_rate
            view, out = memoryview(data), []
            for i, (s, p, m, e) in enumerate(zip(start.tolist(), first.tolist(), second.tolist(), end.tolist(), strict=True)):
                if plain[i]:
                    out.append(bytes(view[s:e]))
                elif spm[i]:
                    out.append(b"".join((behind, view[m:e], ahead, view[s:p], inside, view[p:m])))
                else:
                    out.append(b"".join((ahead, view[s:p], behind, view[m:e], inside, view[p:m])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            columns = [
                batch["doc_id"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(at_first - at_start, pa.int64(), mask=plain),
                pa.array(at_second - at_first, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(
    docs: DataFrame, unit: str = "line", seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per row of ``docs``.

    ``n`` counts units (``line`` or ``char``); of all texts, ``fim_rate`` in a hundred are cut, of these ``spm_rate`` in a
    hundred have the suffix first. No sentinel may begin with a character that any of them holds elsewhere: else where one
    begins after the text before it would not be sure.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}, not {unit!r}")
    if len(set(sentinels)) < 3 or not all(sentinels) or any(s[0] in other[1:] for s in sentinels for other in sentinels):
        raise ValueError(f"sentinels must differ, and none may begin with a character that one holds elsewhere: {sentinels}")
    doc = F.col(f"`{id_col}`")
    rows = docs.select(doc.alias("doc_id"), doc.cast("string").alias("key"), text_of(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_formatted(seed, fim_rate, spm_rate, sentinels, unit), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before it was cut, from the output and its form alone."""
    ahead, behind, inside = map(F.lit, sentinels)

    def of(first: Column, second: Column) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.char_length(first) + 1, F.char_length(output))
        rest = F.split_part(body, second, F.lit(2))
        return F.split_part(body, second, F.lit(1)), F.split_part(rest, inside, F.lit(1)), F.split_part(rest, inside, F.lit(2))

    prefix, suffix, middle = of(ahead, behind)
    suffix2, prefix2, middle2 = of(behind, ahead)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
g AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM g),
p AS (
  SELECT *, coalesce(array_to_string(units[1:lo], ''), '') AS prefix, coalesce(array_to_string(units[lo + 1:hi], ''), '') AS middle,
         coalesce(array_to_string(units[hi + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
