"""Dictionary source: an XML dictionary with DTD entities, compiled once to Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators.numbering import numbered

_RAW = "ent_seq string, k_ele array<struct<keb:string,ke_pri:array<string>>>, r_ele array<struct<reb:string,re_pri:array<string>>>, sense array<struct<gloss:array<string>,pos:array<string>,misc:array<string>,field:array<string>,dial:array<string>>>"


def _texts(values: Column) -> Column:
    """Texts of an element list; missing lists are empty, empty elements drop out."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def parse_entries(xml: Column, entities: Column) -> Column:
    """Raw entry of one <entry> element: known entities expanded (to escaped text), gloss
    attributes dropped so that glosses are plain texts."""
    plain = F.regexp_replace(xml, r"<gloss\s[^>]*>", "<gloss>")
    names = F.array_distinct(F.regexp_extract_all(plain, F.lit("&([A-Za-z0-9_.-]+);"), F.lit(1)))
    own = F.filter(names, lambda n: ~n.isin("amp", "lt", "gt", "quot", "apos"))
    expanded = F.aggregate(own, plain, lambda a, n: F.replace(a, F.concat(F.lit("&"), n, F.lit(";")), F.coalesce(F.try_element_at(entities, n), n)))
    return F.from_xml(expanded, _RAW)


def entities_of(text: Column) -> Column:
    """MAP name -> replacement of the document type's entities; the first declaration counts."""
    pairs = F.regexp_extract_all(text, F.lit(r"<!ENTITY\s+([^\s%]+)\s+\"([^\"]*)\">"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"<!ENTITY\s+([^\s%]+)\s+\"([^\"]*)\">"), F.lit(2))
    zipped = F.transform(F.arrays_zip(pairs.alias("n"), values.alias("v")), lambda e: F.struct(e["n"], e["v"]))
    first = F.filter(zipped, lambda e, i: F.array_position(pairs, e["n"]) == i + 1)
    return F.map_from_entries(first)


#: What ends an entry, and so a record of the scan.
ENTRY_END = "</entry>"


def entry_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, record: a row per entry and one for what follows the last. Files are read by the
    record's delimiter, so a large one is split over tasks and no row holds two entries; (file, block, place) is
    the order of the document."""
    rows = spark.read.option("lineSep", ENTRY_END).text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return rows.select(*where, F.monotonically_increasing_id().alias("place"), F.col("value").alias("record"))


def entity_table(records: DataFrame) -> DataFrame:
    """file, entities: one small map per file, from the record that holds its document type."""
    heads = records.where(F.contains("record", F.lit("<!ENTITY"))).select("file", entities_of(F.col("record")).alias("entities"))
    return heads.groupBy("file").agg(F.first("entities").alias("entities"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """entry_ord, kanji, reading, senses of a dictionary file, or of a folder of them by name, in document
    order. Entities are those of an entry's own file."""
    records = entry_records(spark, path)
    entries = numbered(records.where(F.contains("record", F.lit("<entry>"))), ["file", "block", "place"], "entry_ord")
    split = entries.join(entity_table(records), "file", "left")
    xml = F.concat(F.regexp_extract("record", "(?s)<entry>.*", 0), F.lit(ENTRY_END))
    known = F.coalesce("entities", F.create_map().cast("map<string,string>"))
    parsed = split.select("entry_ord", parse_entries(xml, known).alias("e"))
    element = lambda name, form, pri: F.transform(F.coalesce(F.col(f"e.{name}"), F.array().cast(dict(k_ele="array<struct<keb:string,ke_pri:array<string>>>", r_ele="array<struct<reb:string,re_pri:array<string>>>")[name])), lambda x: F.struct(x[form].alias("form"), _texts(x[pri]).alias("pri")))
    sense = F.transform(
        F.coalesce(F.col("e.sense"), F.array().cast("array<struct<gloss:array<string>,pos:array<string>,misc:array<string>,field:array<string>,dial:array<string>>>")),
        lambda s: F.struct(_texts(s["gloss"]).alias("gloss"), _texts(s["pos"]).alias("pos"), _texts(s["misc"]).alias("misc"), _texts(s["field"]).alias("field"), _texts(s["dial"]).alias("dialect")),
    )
    return parsed.select("entry_ord", element("k_ele", "keb", "ke_pri").alias("kanji"), element("r_ele", "reb", "re_pri").alias("reading"), sense.alias("senses"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def entry_xml(entities: dict[str, str]) -> Column:
    """<entry> element of a row (entry_ord, kanji, reading, senses); a value that an entity stands for is
    written as its reference."""
    names = F.create_map(*(F.lit(x) for name, value in entities.items() for x in (value, f"&{name};"))) if entities else F.create_map().cast("map<string,string>")
    shown = lambda v: F.coalesce(F.try_element_at(names, v), _escaped(v))
    each = lambda values, tag: F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"<{tag}>"), shown(v), F.lit(f"</{tag}>"))), "")
    forms = lambda name, tag, form, pri: F.array_join(F.transform(name, lambda e: F.concat(F.lit(f"<{tag}><{form}>"), _escaped(e["form"]), F.lit(f"</{form}>"), each(e["pri"], pri), F.lit(f"</{tag}>"))), "")
    sense = lambda s: F.concat(F.lit("<sense>"), each(s["pos"], "pos"), each(s["field"], "field"), each(s["misc"], "misc"), each(s["dialect"], "dial"), each(s["gloss"], "gloss"), F.lit("</sense>"))
    return F.concat(F.lit("<entry><ent_seq>"), F.col("entry_ord").cast("string"), F.lit("</ent_seq>"), forms("kanji", "k_ele", "keb", "ke_pri"), forms("reading", "r_ele", "reb", "re_pri"), F.array_join(F.transform("senses", sense), ""), F.lit(ENTRY_END))


def write_dictionary(entries: DataFrame, path: str, entities: dict[str, str], per_file: int = 100_000) -> None:
    """Entries as XML documents of ``per_file`` entries each, in files whose names sort in their order. A form
    must not be null."""
    types = "".join(f'<!ENTITY {name} "{value}">\n' for name, value in entities.items())
    rows = numbered(entries, ["entry_ord"], "n").select(F.format_string("%09d", (F.col("n") / per_file).cast("long")).alias("part"), "n", entry_xml(entities).alias("value"))
    ends = rows.select("part").distinct()
    head = ends.select("part", F.lit(-1).cast("long").alias("n"), F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE words [\n{types}]>\n<words>').alias("value"))
    tail = ends.select("part", F.lit((1 << 63) - 1).alias("n"), F.lit("</words>").alias("value"))
    whole = rows.unionByName(head).unionByName(tail)
    whole.repartition("part").sortWithinPartitions("part", "n").select("part", "value").write.partitionBy("part").text(path)


def compile_dictionary(spark: SparkSession, xml_path: str, out: str) -> DataFrame:
    """Parse once, keep as Parquet for every later run."""
    read_dictionary(spark, xml_path).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
