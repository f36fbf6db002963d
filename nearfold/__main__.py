"""Command line of the jobs, for spark-submit or `python -m nearfold`.

    python -m nearfold publish  --root R --input films.csv --words W --run-date D
    python -m nearfold compare  --root R --input films.csv --words W --run-date D
    python -m nearfold score    --root R --input films.csv [--run-date D] [--sample]
    python -m nearfold rollback --root R --run-date D [--dry-run]
    python -m nearfold convert  --input films.csv --out films.parquet
    python -m nearfold titles   --input films.csv --out T
    python -m nearfold sample   --input films.csv --out S [--rows N]
    python -m nearfold top      --input films.csv --out S [--rows N]

`--words` is a Parquet table (token, vec). `--settings` is a JSON file of
sections with changed keys. Inputs whose name does not end in .csv are read as Parquet.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfold.functions.text import default_stop_words
from nearfold.operators.catalog import prepare
from nearfold.operators.quality import QualityGateFailed
from nearfold.operators.records import title_index
from nearfold.operators.sampling import sample_rows, top_voted
from nearfold.operators.tfidf import TfidfEmbedder
from nearfold.plans.compare import compare_methods, word_vectors_after_tfidf
from nearfold.plans.publish import publish_run
from nearfold.plans.rollback import RollbackRefused, rollback_run
from nearfold.plans.score import score_existing_run
from nearfold.settings import DEFAULTS, with_changes
from nearfold.sources import files
from nearfold.sources.store import RunStore


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument(
        "job", choices=("publish", "compare", "score", "rollback", "convert", "titles", "sample", "top")
    )
    parser.add_argument("--root", help="folder of run artifacts")
    parser.add_argument("--input", help="raw CSV")
    parser.add_argument("--words", help="Parquet table (token, vec)")
    parser.add_argument("--out", help="folder to write")
    parser.add_argument("--run-date", help="YYYY-MM-DD")
    parser.add_argument("--sample", action="store_true", help="score the latest sample run")
    parser.add_argument("--rows", type=int, default=5000)
    parser.add_argument("--dry-run", action="store_true", help="count only")
    parser.add_argument("--settings", help="JSON file of sections with changed keys")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("nearfold").getOrCreate()
    settings = DEFAULTS
    if args.settings:
        with open(args.settings) as f:
            settings = with_changes(json.load(f))
    store = RunStore(spark, args.root) if args.root else None
    day = args.run_date or datetime.now(timezone.utc).date().isoformat()
    k = settings["index"]["k"]
    try:
        if args.job == "publish":
            raw = files.read_films(spark, args.input)
            publish_run(raw, spark.read.parquet(args.words), store, day, settings).show(truncate=False)
        elif args.job == "compare":
            catalog = prepare(files.read_films(spark, args.input), settings["catalog"])
            docs = catalog.select("id", "document").persist()
            words = word_vectors_after_tfidf(spark.read.parquet(args.words))
            methods = [TfidfEmbedder(settings["tfidf"], default_stop_words()), words]
            compare_methods(methods, docs, store, day, k).show(truncate=False)
        elif args.job == "score":
            catalog = prepare(files.read_films(spark, args.input), settings["catalog"]).persist()
            rows, summary = score_existing_run(
                catalog, store, k, settings["eval"], run_date=args.run_date, sample=args.sample
            )
            rows.show(truncate=False)
            summary.show(truncate=False, vertical=True)
        elif args.job == "rollback":
            rollback_run(store, day, settings, args.dry_run).show(truncate=False)
        elif args.job == "convert":
            files.read_films(spark, args.input).write.mode("overwrite").parquet(args.out)
        elif args.job == "titles":
            catalog = prepare(files.read_films(spark, args.input), settings["catalog"])
            files.write_title_index(title_index(catalog), args.out)
        else:
            # Every cell stays as it is in the file; rows are told apart by place.
            raw = files.scan_text_csv(spark, args.input).withColumn("__row", F.monotonically_increasing_id())
            raw = raw.persist()
            if args.job == "sample":
                votes = raw.withColumn("__votes", F.col("vote_count").cast("bigint"))
                picked = sample_rows(votes, "__votes", args.rows, settings["eval"]["seed"], "__row")
            else:
                picked = top_voted(raw, args.rows, "__row")
            files.write_csv(picked.drop("__row", "__votes"), args.out)
    except QualityGateFailed as err:
        print(f"{day} was not published, its quality report says why: {err}", file=sys.stderr)
        return 1
    except RollbackRefused as err:
        print(f"nothing was loaded: {err}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
