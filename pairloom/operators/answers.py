"""Labels of answers: what stands before the last answer header of a token sequence is masked, in native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label of a token that is not learnt.
MASKED = -100


def automaton(header: Sequence[int]) -> list[dict[int, int]]:
    """For each number of header tokens matched so far: the next number by token; tokens that are not listed lead to 0."""
    back, k = [0] * (len(header) + 1), 0  # the longest proper border of each prefix
    for i in range(1, len(header)):
        while k and header[i] != header[k]:
            k = back[k]
        k += header[i] == header[k]
        back[i + 1] = k
    table: list[dict[int, int]] = []
    for state in range(len(header) + 1):
        row = dict(table[back[state]]) if state else {}
        if state < len(header):
            row[header[state]] = state + 1
        table.append({t: s for t, s in row.items() if s})
    return table


def header_end(ids: Column, header: Sequence[int]) -> Column:
    """The place after the last occurrence of ``header`` in ``ids``, occurrences may overlap; -1 if there is none.

    One pass: the automaton takes a token at a time.  Null tokens match nothing.  A null array gives null.
    """
    if not header:
        raise ValueError("the header is empty")
    empty = F.expr("cast(map() as map<bigint,int>)")
    rows = [F.create_map(*[F.lit(x).cast("bigint" if i % 2 == 0 else "int") for t in row.items() for i, x in enumerate(t)]) if row else empty for row in automaton(header)]
    table = F.array(*rows)

    def step(m: Column, token: Column) -> Column:
        state = F.coalesce(F.try_element_at(F.get(table, m["state"]), token.cast("bigint")), F.lit(0))
        return F.struct(
            state.alias("state"), (m["at"] + 1).alias("at"), F.when(state == len(header), m["at"] + 1).otherwise(m["end"]).alias("end")
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    return F.aggregate(ids, start, step, lambda m: m["end"])


def answer_labels(ids: Column, header: Sequence[int]) -> Column:
    """``ids`` with MASKED before the end of the last header; without a header all but the last token are masked."""
    end = header_end(ids, header)
    start = F.when(end < 0, F.greatest(F.size(ids) - 1, F.lit(0))).otherwise(end)
    kind = F.lit(MASKED).cast("bigint")
    return F.concat(F.array_repeat(kind, start), F.slice(F.transform(ids, lambda x: x.cast("bigint")), start + 1, F.size(ids)))
