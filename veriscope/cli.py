"""Commands: ``ground``, ``extract-claims``, ``check-consistency``, ``config``, and ``calibration`` ``fit``, ``eval``, ``export``.

Exit codes: 0 done (``ground``: every claim is something else than ``none``), 1 a claim is unconfirmed, 2 wrong use,
3 nothing to read.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="veriscope")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("ground")
    g.add_argument("claims")
    g.add_argument("evidence", nargs="+")
    g.add_argument("--fuzzy-threshold", type=float)
    g.add_argument("--bm25-threshold", type=float)
    g.add_argument("--output")
    for name in ("extract-claims", "check-consistency"):
        s = sub.add_parser(name)
        s.add_argument("document")
        s.add_argument("--output")
    sub.add_parser("config").add_argument("settings", nargs="*")
    cal = sub.add_parser("calibration").add_subparsers(dest="step", required=True)
    for name in ("fit", "eval", "export"):
        s = cal.add_parser(name)
        if name != "export":
            s.add_argument("records")
        s.add_argument("head")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    spark = spark or SparkSession.builder.appName("veriscope").getOrCreate()
    from veriscope import api, config
    from veriscope.operators import calibrate, consistency, ranks, segment
    from veriscope.plans.shared import Workspace
    from veriscope.sources import readers, writers

    if a.command == "config":
        print(json.dumps(dataclasses.asdict(config.load(*a.settings)), indent=1))
        return 0
    if a.command == "calibration":
        if a.step == "export":
            calibrate.default_head(spark).save(a.head)
            return 0
        rows = readers.records(spark, a.records).withColumn("row_id", F.monotonically_increasing_id())
        frame = Workspace(spark, "calibration").save(api.feature_frame(Workspace(spark, "records").save(rows, "records")), "features")
        if frame.isEmpty():
            print("no labelled records", file=sys.stderr)
            return 3
        if a.step == "fit":
            features = calibrate.varying(frame, list(calibrate.PREDICTORS))
            calibrate.fit(frame, features, "grounded", calibrate.PRIOR).save(a.head)
        else:
            for r in calibrate.evaluate(calibrate.Head.load(a.head), frame, "grounded", "lang").toJSON().toLocalIterator():
                print(r)
        return 0
    if a.command == "ground":
        texts = readers.evidence(spark, *a.evidence)
        if texts.isEmpty():
            print("no readable evidence", file=sys.stderr)
            return 3
        sources = ranks.ranked(texts, [], ["source_path"]).select(F.lit("").alias("group_id"), (F.col("_place") - 1).cast("int").alias("source_index"), "source_path", "text")
        asked = readers.claims(spark, a.claims).select(F.coalesce("id", F.format_string("c%02d", F.col("position") + 1)).alias("claim_id"), F.lit("").alias("group_id"), "claim")
        out = Workspace(spark, "matches").save(api.ground_batch(asked, sources, config.load(fuzzy_threshold=a.fuzzy_threshold, bm25_threshold=a.bm25_threshold)), "matches")
        docs = api.grounding_documents(out)
        if a.output:
            writers.json_documents(docs.select("document"), a.output)
        else:
            for r in docs.toLocalIterator():
                print(r["document"])
        return int(not out.filter("match_type = 'none'").isEmpty())
    doc = readers.evidence(spark, a.document)
    if doc.isEmpty():
        print("no readable document", file=sys.stderr)
        return 3
    found = segment.extract_claims(doc, "source_path") if a.command == "extract-claims" else consistency.check(doc, "source_path")
    if a.output:
        writers.json_documents(found, a.output)
    else:
        for r in found.toJSON().toLocalIterator():
            print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
