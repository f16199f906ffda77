"""Command line: ``python -m duplexa.cli project|baskets|recommend|popular ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators import baskets, recommend
from .operators.project import STRATEGIES, project


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="duplexa")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("project", help="pairs of items (or users) with enough support")
    one.add_argument("--support", type=int, default=2)
    one.add_argument("--bag", action="store_true")
    one.add_argument("--user-space", action="store_true")
    one.add_argument("--hub", type=float, help="drop nodes above mean + HUB standard deviations")
    one.add_argument("--strategy", choices=STRATEGIES, default="join")
    one.add_argument("--rounds", type=int, default=4)
    two = sub.add_parser("baskets", help="items of each user")
    two.add_argument("--no-user", action="store_true")
    three = sub.add_parser("recommend", help="top items by ALS")
    for name, kind, default in (("features", int, 20), ("lambda", float, 0.1), ("iterations", int, 10), ("alpha", float, 40.0), ("n", int, 500)):
        three.add_argument(f"--{name}", type=kind, default=default)
    three.add_argument("--implicit", action="store_true")
    four = sub.add_parser("popular", help="most popular unseen items of each user")
    four.add_argument("--n", type=int, default=500)
    for x in (one, two, three, four):
        x.add_argument("input")
        x.add_argument("output")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("duplexa").getOrCreate()
    if a.command == "recommend":
        ratings = sources.preferences(spark, a.input, "\t")
        model = recommend.als(ratings, a.features, getattr(a, "lambda"), a.iterations, a.implicit, a.alpha)
        lists(recommend.als_top(model, ratings, a.n)).write.mode("overwrite").text(a.output)
        return
    edges = sources.edges(spark, a.input)
    if a.command == "project":
        sources.write_tsv(project(edges, a.support, "bag" if a.bag else "set", strategy=a.strategy, rounds=a.rounds, user_space=a.user_space, hub_k=a.hub), a.output)
    elif a.command == "baskets":
        sources.basket_text(baskets.baskets(edges), not a.no_user).write.mode("overwrite").text(a.output)
    else:
        lists(recommend.popular_unseen(edges, a.n)).write.mode("overwrite").text(a.output)


def lists(recs):
    """Ranked rows as text lines."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items")
    return sources.recommendation_text(recs.groupBy("user").agg(items))


if __name__ == "__main__":
    main()
