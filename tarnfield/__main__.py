"""Command line: `python -m tarnfield VERB ...`."""

from __future__ import annotations

import argparse
import json

from tarnfield.session import local_session


def _args() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tarnfield")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of the queries")
    run = verbs.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="a folder for Parquet; without it the first rows are shown")
    smoke = verbs.add_parser("smoke", help="answer planned calls (JSON lines) by the mock responder")
    smoke.add_argument("calls")
    estimate = verbs.add_parser("estimate", help="cost of planned calls under a price file")
    estimate.add_argument("calls")
    estimate.add_argument("prices")
    estimate.add_argument("--output-tokens", type=int, default=256)
    estimate.add_argument("--budget", type=float)
    analyse = verbs.add_parser("analyse", help="numbers of each condition under a results folder")
    analyse.add_argument("results")
    analyse.add_argument("--reference", help="a condition that the others are compared with")
    episode = verbs.add_parser("episode", help="run, log and sum up the conditions of an episode over a library")
    episode.add_argument("episode", help="a YAML file that names the base pipeline and its conditions")
    episode.add_argument("documents", help="a folder of Markdown documents")
    episode.add_argument("items", help="a JSON-lines file")
    episode.add_argument("results")
    episode.add_argument("--only", help="one condition's name")
    episode.add_argument("--mock", action="store_true", help="answer and judge by the mock responder where a condition measures in full; else only its search is measured")
    score = verbs.add_parser("score", help="rank a case's candidates by a rule")
    score.add_argument("rule")
    score.add_argument("case")
    return parser.parse_args()


CALL = "call_id string, request_hash string, provider string, model string, prompt string"


def main() -> None:
    args = _args()
    if args.verb == "list":
        from tarnfield.queries import QUERIES

        print("\n".join(sorted(QUERIES)))
        return
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    if args.verb == "run":
        from tarnfield.queries import QUERIES

        out = QUERIES[args.query](spark, args.tables)
        out.write.mode("overwrite").parquet(args.out) if args.out else out.show(truncate=False)
    elif args.verb == "smoke":
        from tarnfield.operators.responders import MockResponder, answered

        answered(spark.read.schema(CALL).json(args.calls), MockResponder).show(truncate=False)
    elif args.verb == "estimate":
        from tarnfield.functions.text import token_count
        from tarnfield.operators.responders import check_budget
        from tarnfield.sources.configs import load_prices

        loaded = load_prices(spark, args.prices)
        if loaded is None:
            raise SystemExit(f"no prices at {args.prices}")
        calls = spark.read.schema(CALL).json(args.calls).dropDuplicates(["request_hash"]).join(F.broadcast(loaded[0]), ["provider", "model"], "left")
        cost = (token_count(F.col("prompt")) * F.col("price_in") + args.output_tokens * F.col("price_out")) / 1000000
        total = calls.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.when(F.count_if(cost.isNull()) == 0, F.sum(cost)).alias("cost_high"))
        total.show(truncate=False)
        if args.budget is not None:
            print(check_budget(total, args.budget))
    elif args.verb == "analyse":
        from tarnfield.sources import itemlog

        log = itemlog.read_all(spark, args.results)
        if args.reference:
            from tarnfield.plans.condition import episode_report

            print("\n".join(episode_report(log, args.reference).orderBy("condition").toJSON().collect()))  # a row for each condition
            return
        right = F.coalesce(F.col("verdict.correct") & F.col("verdict.faithful"), F.lit(False))
        log.groupBy("condition").agg(
            F.count("*").alias("items"), F.count_if(F.col("answerable") & (F.col("evidence_rank") <= 5)).alias("found"), F.count_if(F.col("answerable") & right).alias("right"),
            F.count_if(~F.col("answerable") & F.coalesce("verdict.declined", F.lit(False))).alias("declined"), F.count_if(F.size("leaks") > 0).alias("leaks"),
        ).orderBy("condition").show(truncate=False)
    elif args.verb == "episode":
        from tarnfield.operators.responders import MockResponder
        from tarnfield.plans.condition import Model, from_library, run_condition
        from tarnfield.sources.configs import load_episode
        from tarnfield.sources.library import read_documents, read_items

        _, conditions = load_episode(args.episode)
        chosen = [c for c in conditions if args.only in (None, c.name)]
        if not chosen:
            raise SystemExit(f"no condition {args.only}")
        tables = from_library(read_documents(spark, args.documents), read_items(spark, args.items))
        for c in chosen:
            model = Model("mock", "mock") if args.mock and c.measure == "full" else None
            print(run_condition(*tables, c.spec, c.name, args.results, model, make=MockResponder).toJSON().first())
    elif args.verb == "score":
        from tarnfield.sources.configs import load_case, load_rule

        rule = load_rule(args.rule)
        case = load_case(spark, args.case, rule)
        total = F.round(sum((F.col(f"`{k}`") * w for k, w in rule.weights.items()), F.lit(0.0)), 6)
        print(json.dumps([r.asDict() for r in case.where("gates_passed").withColumn("total", total).orderBy(F.desc("total"), "id").collect()], indent=1))


if __name__ == "__main__":
    main()
