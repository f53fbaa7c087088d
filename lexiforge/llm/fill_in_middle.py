"""Fill-in-the-middle: texts cut in three and reordered, by DuckDB SQL over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexiforge.llm.common import documents

#: Form marks: a text that holds one of them stays plain, so that outputs can be taken apart.
MARKS = ("<P>", "<S>", "<M>")
#: Rows and bytes of text that one SQL statement sees at most; a longer text is alone in its statement.
ROWS, BYTES = 1024, 4 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"

#: The draws are digests of ``seed:doc_id``; of 100 texts ``rate`` are cut, of 100 cut ones ``spm`` start with the suffix.
SQL = """
with source as (
    select doc_id, coalesce(text, '') as whole, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as digest from batch
), units as (
    select *, regexp_extract_all(whole, '[A-Za-z]+|[^A-Za-z]') as unit,
        list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(digest, i, 8))::bigint) as h
    from source
), draws as (
    select *, len(unit) as n,
        least(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) as low, greatest(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) as high,
        case when whole = '' or contains(whole, '<P>') or contains(whole, '<S>') or contains(whole, '<M>') or h[3] % 100 >= {rate} then 'plain'
             when h[4] % 100 < {spm} then 'spm' else 'psm' end as form
    from units
), parts as (
    select doc_id, whole, n, form,
        case when form <> 'plain' then coalesce(array_to_string(list_slice(unit, 1, low), ''), '') end as prefix,
        case when form <> 'plain' then coalesce(array_to_string(list_slice(unit, low + 1, high), ''), '') end as middle,
        case when form <> 'plain' then coalesce(array_to_string(list_slice(unit, high + 1, n), ''), '') end as suffix
    from draws
), formed as (
    select *, case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else whole end as output
    from parts
), rebuilt as (
    select *, case form
        when 'psm' then substr(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
        when 'spm' then split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || substr(split_part(output, '<P>', 1), 4)
        else output end as restored
    from formed
)
select doc_id::bigint as doc_id, n::bigint as n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars,
    {output} as output, sha256(output) as output_sha256, sha256(restored) as restored_sha256
from rebuilt
"""


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of bounded rows and text bytes; no row is parted or left out."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(upto, upto[at] + BYTES, "right")) - 1, at + 1)
        end = min(end, at + ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, texts: bool = True) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text; further columns are ignored): n units, form, the lengths
    of prefix and middle in code points, the output, its digest, and the digest of the text that is
    rebuilt from output and form. Without ``texts`` the output column is null.

    Null texts count as empty and stay plain (n is 0); a null doc_id draws from ``seed:`` alone. Rows of one id draw
    alike whatever their texts; repeated rows are rows of their own; an empty table gives no rows. Very
    long texts are cut whole, one to a statement. No shuffle; a lost task is a rerun of its batches.
    """
    sql = SQL.format(seed=int(seed), rate=int(rate), spm=int(spm), output="output" if texts else "null::varchar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for batch in batches:
                for part in _slices(batch):
                    db.register("batch", pa.Table.from_batches([part]))
                    got = db.sql(sql).to_arrow_table()
                    db.unregister("batch")
                    yield from got.to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document's form and digests: see fill_in_middle."""
    return fill_in_middle(documents(spark, sf_dir), texts=False).drop("output")
