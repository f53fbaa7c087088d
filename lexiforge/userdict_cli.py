"""Command line of the user dictionary: n-gram candidates of texts, and rows for what a dictionary knows of them."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.profiles import LATIN_LETTERS
from lexiforge.operators.tokenizers import MorphologicalTokenizer, RegexTokenizer
from lexiforge.operators.userdict import candidate_ngrams, user_dictionary
from lexiforge.sources.dictionary_xml import compile_dictionary
from lexiforge.sources.files import read_lines
from lexiforge.sources.sinks import write_lines, write_table

log = logging.getLogger("lexiforge")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiforge.userdict_cli")
    p.add_argument("command", choices=("candidates", "build", "compile"), help="list n-grams; rows for dictionary forms in the texts; dictionary XML to Parquet")
    p.add_argument("-i", "--input", required=True, help="folder of .txt files, a file, or the dictionary XML to compile")
    p.add_argument("-o", "--output", required=True, help="folder to write")
    p.add_argument("--dictionary", help="compiled dictionary (Parquet), for build")
    p.add_argument("--latin", action="store_true", help="n-grams of Latin letters instead of Japanese characters")
    p.add_argument("--analyse", action="store_true", help="leave out forms that the morphological analyser takes for one token")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("lexiforge-userdict").getOrCreate()
    if a.command == "compile":
        log.info("%s entries", compile_dictionary(spark, a.input, a.output).count())
        return
    glob = None if a.input.endswith(".txt") else "*.txt"
    lines, watch = read_lines(spark, a.input, recursive=True, glob=glob), Observation()
    lines = lines.observe(watch, F.count(F.lit(1)).alias("lines"))
    members = LATIN_LETTERS if a.latin else None
    if a.command == "candidates":
        write_lines(candidate_ngrams(lines, members=members), "candidate", a.output)
    else:
        tokenizer = MorphologicalTokenizer() if a.analyse else RegexTokenizer(".")
        write_table(user_dictionary(lines, spark.read.parquet(a.dictionary), tokenizer, members), a.output)
    log.info("%s", watch.get)


if __name__ == "__main__":
    main()
