"""Columns that have the name of an operator's helper come through, in either case."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import wavebook.llm
from wavebook.llm import (
    decontaminate, exact_dedup, fill_in_middle, language, mixing, near_dedup, quality, resharding, secret_scan,
    suffix_dedup, suffix_tree_lm, url_filter,
)


def helper_names():
    """Every name that a module of the operators gives a column, read from its text."""
    found = set()
    for module in Path(wavebook.llm.__file__).parent.glob("*.py"):
        text = module.read_text()
        found |= set(re.findall(r"""(?:alias|withColumn|withColumnRenamed|fresh)\((?:df, )?["']([A-Za-z_]\w*)["']""", text))
        found |= set(re.findall(r"""["'](_\w+)["']""", text))
    return sorted(found - {"doc_id", "text", "source", "lang", "url", "was"})


def operators(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spoken = language.train(docs)
    good = quality.train(docs.withColumn("label", F.lit("MINE")), spark.read.parquet(f"{folder}/labels.parquet"))
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    rules = spark.createDataFrame([("example.org", "/", "block")], "host string, path string, action string")
    return {
        "near dedup": near_dedup.near_dedup, "exact dedup": exact_dedup.exact_dedup, "mix": mixing.mix,
        "reshard": lambda df: resharding.reshard(df, 3, "was"), "suffix dedup": suffix_dedup.suffix_dedup,
        "score": suffix_tree_lm.score, "language": lambda df: language.identify(df, spoken),
        "quality": lambda df: quality.classify(df, good), "secrets": secret_scan.secret_scan,
        "decontaminate": lambda df: decontaminate.decontaminate(df, benchmark),
        "fill in middle": fill_in_middle.fill_in_middle, "urls": lambda df: url_filter.url_filter(df, rules),
    }


@pytest.mark.parametrize("upper", [False, True])
def test_columns_of_any_name_come_through(spark, upper):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang").limit(40)
    names = [n.upper() if upper else n for n in helper_names()]
    names = list({n.lower(): n for n in names}.values())
    assert len(names) > 60
    mine = {n: F.concat(F.lit(f"MINE {n} "), F.col("doc_id").cast("string")) for n in names}
    table = docs.withColumns({"was": F.col("doc_id") % 4, "url": F.lit("http://a.example.org/x"), **mine})
    plain = docs.withColumns({"was": F.col("doc_id") % 4, "url": F.lit("http://a.example.org/x")})
    wrong = {}
    for name, operator in operators(spark).items():
        try:
            out, want = operator(table), operator(plain)
            added = [c for c in want.columns if c not in plain.columns]
            lowered = {c.lower() for c in added}
            kept = [n for n in names if n.lower() not in lowered]
            rows = {r.doc_id: r for r in out.collect()}
            assert len(rows) == 40 and not [c for c in out.columns if out.columns.count(c) > 1]
            assert all(r[n] == f"MINE {n} {i}" for i, r in rows.items() for n in kept), "changed"
            same = {r.doc_id: [r[c] for c in added] for r in want.collect()}
            assert {i: [r[c] for c in added] for i, r in rows.items()} == same, "results"
        except Exception as error:  # noqa: BLE001  all operators are tried before the test fails
            wrong[name] = str(error)[:300]
    assert not wrong
