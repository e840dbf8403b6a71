"""``python -m rulespark.cli mine FILES...``, ``query "?a,?b" "r(?a,?b)" FILES...``, ``stats FILES...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rulespark.operators.miner import OPERATORS, Config, Miner, bias_class, header, report_line
from rulespark.operators.stats import summary
from rulespark.plans import bgp
from rulespark.sources.readers import LOADERS, load_kb


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rulespark")
    sub = p.add_subparsers(dest="command", required=True)
    mine = sub.add_parser("mine")
    mine.add_argument("--max-atoms", type=int, default=3)
    mine.add_argument("--min-head-size", type=int, default=100)
    mine.add_argument("--min-support", type=int, default=100)
    mine.add_argument("--min-head-coverage", type=float, default=0.01)
    mine.add_argument("--prune-by", choices=["headcoverage", "support"], default="headcoverage")
    mine.add_argument("--min-std-confidence", type=float, default=0.0)
    mine.add_argument("--min-pca-confidence", type=float, default=0.1)
    mine.add_argument("--constants", action="store_true")
    mine.add_argument("--only-constants", action="store_true")
    mine.add_argument("--recursivity", type=int, default=3)
    mine.add_argument("--one-variable", action="store_true")
    mine.add_argument("--count-subject", action="store_true")
    mine.add_argument("--omit-std", action="store_true")
    mine.add_argument("--refine-perfect", action="store_true", help="refine rules of confidence 1 too")
    mine.add_argument("--refine-all-lengths", action="store_true", help="without the pruning by length, which loses nothing")
    mine.add_argument("--functionality-heuristic", action="store_true", help="drop path rules by their estimated confidence")
    mine.add_argument("--skyline-on", choices=["pca", "std"], default="pca")
    mine.add_argument("--operators", default=",".join(OPERATORS), help="refinement operators, separated by commas")
    mine.add_argument("--bias", default="rulespark.operators.miner:Miner", help="a miner of one's own, module:Class")
    mine.add_argument("--datalog", action="store_true")
    mine.add_argument("--verbose", action="store_true", help="with bounds and estimates")
    mine.add_argument("--at-the-end", action="store_true", help="print no rule before the last is found")
    for name in ("head-targets", "head-excluded", "body-targets", "body-excluded"):
        mine.add_argument(f"--{name}", default="", help="relations, separated by commas")
    query = sub.add_parser("query")
    query.add_argument("variables")
    query.add_argument("atoms")
    for s in (mine, query, sub.add_parser("stats")):
        s.add_argument("--cores", default="*", help="threads on one machine")
        s.add_argument("--kind", choices=[*LOADERS, "index"], default="facts")
        s.add_argument("files", nargs="+")
    return p


def config_of(args: argparse.Namespace) -> Config:
    listed = {n: frozenset(filter(None, getattr(args, n).split(","))) for n in ("head_targets", "head_excluded", "body_targets", "body_excluded")}
    same = ("max_atoms", "min_support", "min_head_coverage", "prune_by", "min_std_confidence", "min_pca_confidence", "constants", "only_constants", "recursivity", "one_variable", "count_subject", "omit_std", "functionality_heuristic", "skyline_on")
    least = args.min_support if args.prune_by == "support" else args.min_head_size
    return Config(**{n: getattr(args, n) for n in same}, **listed, min_head_size=least, operators=tuple(filter(None, args.operators.split(","))), stop_at_perfect=not args.refine_perfect, use_max_length=not args.refine_all_lengths)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("rulespark")
    spark = (builder if args.cores == "*" else builder.master(f"local[{args.cores}]")).getOrCreate()
    kb = load_kb(spark, args.files, args.kind)
    if args.command == "mine":
        config = config_of(args)
        print(header(not config.omit_std, args.verbose))
        show = lambda rule: print(report_line(rule, args.datalog, not config.omit_std, args.verbose), flush=True)
        found = bias_class(args.bias)(kb, config, None if args.at_the_end else show).mine()
        for rule in found if args.at_the_end else ():
            show(rule)
    elif args.command == "query":
        rows = bgp.query(kb, args.variables, args.atoms)
        n = 0
        for n, row in enumerate(rows.toLocalIterator(), 1):
            print(*row, sep="\t")
        print(n)
    else:
        for row in summary(kb).orderBy("r").toLocalIterator():
            print(*row, sep="\t")


if __name__ == "__main__":
    main()
