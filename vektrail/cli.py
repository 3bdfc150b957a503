"""``python -m vektrail.cli``: named queries, and the whole way of moving an index.

    list | run NAME DATA OUT | report NAME DATA [--html|--json] | explain NAME DATA

    probe OLD NEW [--qrels Q]                  what a map from NEW to OLD keeps, and a recommendation
    fit OLD NEW OUT [--kind KIND]              fit a map NEW -> OLD and save it; kind ``auto`` takes the best
    eval ADAPTER OLD NEW                       mean cosine of a saved map on held-out pairs
    compare OLD NEW [NEW ...]                  mean cosine of the best map of each candidate model
    expose A B                                 blind alignment of two tables of vectors
    adapter inspect PATH | adapter profiles
    migrate INDEX ADAPTER JOB                  rewrite an index; goes on where it stopped
    status|pause|resume|rollback|gc JOB INDEX  a job's counts, switches, put back, and remove its work files
    audit list|verify|export CHAIN [OUT]
    doctor                                     versions, shared folder, cores

OLD, NEW and INDEX are Parquet tables with id and v; Q has query_id, doc_id, grade.
Exit codes: 0 done, 1 a check failed, 2 unknown name or missing input, 3 input refused.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektrail import reports
from vektrail.functions import vec
from vektrail.operators import adapters, audit, exposure
from vektrail.plans.models import IS_FIT, pairs
from vektrail.plans.registry import collect
from vektrail.session import delete_path, local_session, shared_dir

DONE, FAILED, UNKNOWN, REFUSED = 0, 1, 2, 3
AUTO = ("procrustes_centered", "linear", "low_rank_affine")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", vec.doubles(F.col("v")).alias("v"))


def _score(both: DataFrame, maps: list[adapters.Adapter]) -> list[float]:
    """Mean cosine of each map on the pairs that were not fitted on."""
    row = both.where(f"NOT ({IS_FIT})").agg(*[F.avg(vec.cosine(a.udf()(F.col("src")), F.col("dst"))).alias(f"c{i}") for i, a in enumerate(maps)]).first()
    return [float("nan") if x is None else float(x) for x in row]


def _best(both: DataFrame, kinds: tuple[str, ...]) -> tuple[adapters.Adapter, float]:
    maps = adapters.fit_candidates(adapters.Moments.of(both.where(IS_FIT)), list(kinds))
    if not maps:
        raise KeyError(f"no map {', '.join(kinds)}")
    rows = [(a.kind, s, a.n_params) for a, s in zip(maps, _score(both, maps), strict=True)]
    name = adapters.select_best(both.sparkSession.createDataFrame(rows, "name string, score double, n_params int")).first().name
    return next((a, r[1]) for a, r in zip(maps, rows, strict=True) if a.kind == name)


def probe(spark: SparkSession, args: argparse.Namespace) -> int:
    from vektrail.operators import groundtruth
    from vektrail.plans.fixtures import IS_QUERY
    from vektrail.plans.probe import run_probe

    old, new = _index(spark, args.old), _index(spark, args.new)
    qrels = spark.read.parquet(args.qrels) if args.qrels else groundtruth.sparse(groundtruth.tier0(new, IS_QUERY, 10)).withColumn("grade", F.lit(1))
    print(reports.as_json(run_probe(old, new, qrels)))
    return DONE


def fit(spark: SparkSession, args: argparse.Namespace) -> int:
    both = pairs(_index(spark, args.new), _index(spark, args.old))
    best, score = _best(both, AUTO if args.kind == "auto" else (args.kind,))
    best.save(spark, args.out, evaluation={"held_out_cosine": score})
    print(json.dumps({"kind": best.kind, "n_params": best.n_params, "held_out_cosine": round(score, 6)}))
    return DONE


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    both = pairs(_index(spark, args.new), _index(spark, args.old))
    print(json.dumps({"held_out_cosine": round(_score(both, [adapters.Adapter.load(spark, args.adapter)])[0], 6)}))
    return DONE


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    old = _index(spark, args.old)
    rows = []
    for path in args.new:
        best, score = _best(pairs(_index(spark, path), old), AUTO)
        rows.append({"model": path, "kind": best.kind, "held_out_cosine": round(score, 6)})
    print(json.dumps(sorted(rows, key=lambda r: (-r["held_out_cosine"], r["model"])), indent=1))
    return DONE


def expose(spark: SparkSession, args: argparse.Namespace) -> int:
    print(reports.as_json(exposure.measure(_index(spark, args.a), _index(spark, args.b))))
    return DONE


def adapter(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.action == "profiles":
        print("\n".join(sorted(adapters.FITS)))
        return DONE
    if not args.path:
        raise KeyError("adapter inspect needs a path")
    a = adapters.Adapter.load(spark, args.path)
    print(json.dumps({"kind": a.kind, "dim": a.dim, "n_params": a.n_params, "parts": {k: list(v.shape) for k, v in {"w": a.w, "c": a.c, **a.extra}.items()}}))
    return DONE


def migrate(spark: SparkSession, args: argparse.Namespace) -> int:
    from vektrail.streaming.rewrite import Rewrite

    job = Rewrite(spark, args.job, adapters.Adapter.load(spark, args.adapter), _index(spark, args.index))
    job.prepare()
    got = job.run()
    print(json.dumps(vars(got)))
    return DONE if got.finished and not got.failed else FAILED


def job(spark: SparkSession, args: argparse.Namespace) -> int:
    import numpy as np

    from vektrail.streaming.rewrite import Rewrite

    it = Rewrite(spark, args.job, adapters.Adapter("identity", np.eye(1), np.zeros(1), 1, 0), _index(spark, args.index))
    if args.command == "pause":
        it.pause()
    elif args.command == "resume":
        it.resume()
    elif args.command == "rollback":
        it.rolled_back().write.parquet(args.out or f"{args.job}/rolled-back")
    elif args.command == "gc":
        if not it.outcome().finished:
            print("the job is not finished", file=sys.stderr)
            return FAILED
        for name in ("work", "checkpoint"):
            delete_path(spark, f"{args.job}/{name}")
    else:
        print(json.dumps(vars(it.outcome())))
    return DONE


def records(spark: SparkSession, args: argparse.Namespace) -> int:
    chain = spark.read.parquet(args.chain)
    if args.action == "verify":
        got = audit.verify(chain).first()
        print(json.dumps(got.asDict()))
        return FAILED if got.broken else DONE
    if args.action == "export":
        if not args.out:
            raise KeyError("audit export needs a folder")
        audit.export(chain).write.text(args.out)
        return DONE
    print(reports.as_json(audit.listed(chain)))
    return DONE


def doctor(spark: SparkSession, args: argparse.Namespace) -> int:
    import numpy
    import pyarrow

    print(json.dumps({"spark": spark.version, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "master": spark.sparkContext.master, "cores": spark.sparkContext.defaultParallelism, "shared": shared_dir(spark)}))
    return DONE


def query(spark: SparkSession | None, args: argparse.Namespace) -> int:
    queries, _ = collect()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return DONE
    if args.name not in queries:
        raise KeyError(f"no query {args.name}")
    df = queries[args.name](spark or local_session(), args.data)
    if args.command == "run":
        df.write.parquet(args.out)
    elif args.command == "explain":
        df.explain("formatted")
    else:
        print(reports.as_json(df) if args.json else reports.page(df, args.name) if args.html else reports.markdown(df, args.name))
    return DONE


# command: (function, positional arguments, options); ``*`` marks a list, ``?`` one that may be missing
COMMANDS: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {
    "list": (query, (), ()),
    "run": (query, ("name", "data", "out"), ()),
    "report": (query, ("name", "data"), ("html", "json")),
    "explain": (query, ("name", "data"), ()),
    "probe": (probe, ("old", "new"), ("qrels=",)),
    "fit": (fit, ("old", "new", "out"), ("kind=auto",)),
    "eval": (evaluate, ("adapter", "old", "new"), ()),
    "compare": (compare, ("old", "new*"), ()),
    "expose": (expose, ("a", "b"), ()),
    "adapter": (adapter, ("action", "path?"), ()),
    "migrate": (migrate, ("index", "adapter", "job"), ()),
    **{name: (job, ("job", "index"), ("out=",)) for name in ("status", "pause", "resume", "rollback", "gc")},
    "audit": (records, ("action", "chain", "out?"), ()),
    "doctor": (doctor, (), ()),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vektrail", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, places, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place.rstrip("*?"), nargs={"*": "+", "?": "?"}.get(place[-1]))
        for option in options:
            flag, eq, default = option.partition("=")
            p.add_argument(f"--{flag}", **({"default": default or None} if eq else {"action": "store_true"}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    run = COMMANDS[args.command][0]
    try:
        return run(None if run is query else local_session(), args)
    except (KeyError, FileNotFoundError, AnalysisException) as error:
        print(str(error).splitlines()[0] if str(error) else repr(error), file=sys.stderr)
        return UNKNOWN
    except ValueError as error:
        print(error, file=sys.stderr)
        return REFUSED


if __name__ == "__main__":
    sys.exit(main())
