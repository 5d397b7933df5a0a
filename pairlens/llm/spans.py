"""Positions of regular expression matches, with column expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters right before a match, and right behind it, that are kept as its context.
REACH = 80
#: Hits of a text whose positions are added up together.
CHUNK = 256
FOUND = "struct<start:bigint,stop:bigint,hit:string,tail:string,head:string>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def locate(rows: DataFrame, pattern: str, column: str, text: str = "text", keep: str | None = None, out: str | None = None) -> DataFrame:
    """``rows`` with an array of FOUND for each match of ``pattern``.

    ``keep`` is a SQL condition on a hit x, ``out`` a SQL expression of x that takes its place.
    Text between matches and matches themselves come from the same scan order, so their
    lengths add up to positions in code points.  ``tail`` is the REACH characters of the text
    before a match, whatever they hold; ``head`` those behind it, over two further matches at most.
    """
    kept = [f"`{c}`" for c in rows.columns]
    none = "CAST(array() AS array<{}>)"
    rows = rows.select(*kept, F.expr(f"split(`{text}`, {quoted(pattern)}, -1)").alias("gaps"))
    rows = rows.select(*kept, "gaps", F.expr(f"CASE WHEN size(gaps) > 1 THEN regexp_extract_all(`{text}`, {quoted(pattern)}, 0) ELSE {none.format('string')} END").alias("hits"))
    ahead = f"left(concat_ws('', gaps[i + 1], get(hits, i + 1), get(gaps, i + 2), get(hits, i + 2), get(gaps, i + 3)), {REACH})"
    items = f"transform(hits, (x, i) -> named_struct('g', CAST(length(gaps[i]) AS BIGINT), 'n', CAST(length(x) AS BIGINT), 'hit', x, 'gap', right(gaps[i], {REACH}), 'head', {ahead}))"
    rows = rows.select(*kept, F.expr(items).alias("items"))
    # Prefix sums in two levels: a step copies a chunk's list, never that of the whole text.
    part = f"""aggregate(part,
        named_struct('at', 0L, 'tail', '', 'out', {none.format(FOUND)}),
        (acc, m) -> named_struct(
            'at', acc.at + m.g + m.n,
            'tail', right(concat(acc.tail, m.gap, m.hit), {REACH}),
            'out', concat(acc.out, array(named_struct('start', acc.at + m.g, 'stop', acc.at + m.g + m.n, 'hit', m.hit, 'tail', right(concat(acc.tail, m.gap), {REACH}), 'head', m.head)))))"""
    chunks = f"transform(transform(sequence(0, (size(items) - 1) DIV {CHUNK}), c -> slice(items, CAST(c * {CHUNK} + 1 AS INT), {CHUNK})), part -> {part})"
    rows = rows.select(*kept, F.expr(f"CASE WHEN size(items) > 0 THEN {chunks} ELSE {none.format(f'struct<at:bigint,tail:string,out:array<{FOUND}>>')} END").alias("chunks"))
    firsts = "aggregate(chunks, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), (acc, c) -> named_struct('at', acc.at + c.at, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
    rows = rows.select(*kept, "chunks", F.expr(firsts).alias("firsts"))
    # A full chunk holds more than REACH characters, so what lies before a chunk is its neighbour's tail.
    tail = f"CASE WHEN k > 0 AND length(x.tail) < {REACH} THEN right(concat(chunks[k - 1].tail, x.tail), {REACH}) ELSE x.tail END"
    both = f"flatten(transform(chunks, (c, k) -> transform(c.out, x -> named_struct('start', x.start + firsts[k], 'stop', x.stop + firsts[k], 'hit', x.hit, 'tail', {tail}, 'head', x.head))))"
    both = f"filter({both}, x -> {keep})" if keep else both
    return rows.select(*kept, F.expr(f"transform({both}, x -> {out})" if out else both).alias(column))
