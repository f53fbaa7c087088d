"""Command line: mine a folder of texts into word files."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from lexiforge.functions.profiles import JA, LATIN
from lexiforge.operators.token_cache import TokenCache
from lexiforge.operators.tokenizers import JAPANESE_RUNS, MorphologicalTokenizer, RegexTokenizer
from lexiforge.plans.mining import Config, mine
from lexiforge.sources.dictionary_xml import read_dictionary
from lexiforge.sources.files import read_corpus
from lexiforge.sources.sinks import dump_sentences, resolve_output, write_word_tables, write_words

log = logging.getLogger("lexiforge")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiforge")
    p.add_argument("-i", "--input", required=True, help="file or folder of texts")
    p.add_argument("-o", "--output", help="word file or folder")
    p.add_argument("-f", "--min-frequency", type=int, default=4)
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-d", "--debug", action="store_true", help="also dump the sentences")
    p.add_argument("--dictionary", help="dictionary XML; or a folder of compiled Parquet")
    p.add_argument("--parts", action="store_true", help="write folders of CSV parts instead of single files: for any size and store")
    p.add_argument("--cache", help="folder of the token cache: what was tokenised before isn't tokenised again")
    p.add_argument("--tokenizer", choices=("runs", "latin", "morphological"), default="runs")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO)
    spark = SparkSession.builder.appName("lexiforge").getOrCreate()
    entries = None
    if a.dictionary:
        entries = read_dictionary(spark, a.dictionary) if a.dictionary.endswith(".xml") else spark.read.parquet(a.dictionary)
    tokenizer = {"runs": JAPANESE_RUNS, "latin": RegexTokenizer(), "morphological": MorphologicalTokenizer()}[a.tokenizer]
    config = Config(LATIN if a.tokenizer == "latin" else JA, tokenizer, a.min_frequency or 4)
    target = Path(a.output or a.input) if a.parts else resolve_output(a.input, a.output)
    cache = TokenCache(spark, a.cache, f"{config.profile.name}:{tokenizer.fingerprint}") if a.cache else None
    got = mine(read_corpus(spark, a.input, a.recursive), entries, config, cache)
    log.info("%s", got.counters)
    if got.cached:
        log.info("%s", got.cached)
    if a.debug:
        dump_sentences(got.sentences, f"{target.with_suffix('')}.sentences")
    log.info("%s: %s", target, write_word_tables(got.words, a.output or f"{a.input.rstrip('/')}.words") if a.parts else write_words(got.words, target))


if __name__ == "__main__":
    main()
