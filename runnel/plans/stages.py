"""A declarative list of stages, compiled to a flow: publishers, processors and terminals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import NoSuchItem
from ..flow import Flow
from ..sources import create

#: Each stage is a name and its arguments. Publishers begin a list of stages.
PUBLISHERS = {
    "of": lambda spark, values, kind, name="item": create.items(spark, values, kind, name),
    "failed": lambda spark, message, kind="int": create.failure(spark, message, kind),
    "publisher": lambda spark, source, order="pos", kind="int": create.from_any(spark, source, order, kind),
    "fromFuture": lambda spark, future, kind: create.items(spark, [_not_null(future.result())], kind),
    "fromFutureNullable": lambda spark, future, kind: create.optional(spark, future.result(), kind),
    "concat": lambda spark, first, second: compile_stages(None, first, spark).concat(compile_stages(None, second, spark)),
}
PROCESSORS = {
    "map": lambda f, **columns: f.map(**{n: F.expr(e) for n, e in columns.items()}),
    "filter": lambda f, predicate: f.filter(F.expr(predicate)),
    "peek": lambda f, name="peek", **metrics: f.observe(name, **{n: F.expr(e) for n, e in metrics.items()}),
    "flatMapIterable": lambda f, items, name: f.flat_map(F.expr(items), name),
    "flatMap": lambda f, inner, on, **how: f.sub_flows(inner, on, **how),
    "flatMapFuture": lambda f, lookup, on: f.enrich(lookup, on, "inner"),
    "distinct": lambda f, keys: f.distinct(*keys),
    "limit": lambda f, n: f.first(n),
    "skip": lambda f, n: f.skip_first(n),
    "takeWhile": lambda f, predicate: f.take_while(F.expr(predicate)),
    "dropWhile": lambda f, predicate: f.drop_while(F.expr(predicate)),
    "onComplete": lambda f, other: f.then(other),
    "onError": lambda f, failed, message: f.transform_failure(F.expr(failed), F.expr(message)),
    "onTerminate": lambda f, fn: f.on_termination(fn),
    "onErrorResume": lambda f, failed, **values: f.recover_with_item(F.expr(failed), **{n: F.expr(e) for n, e in values.items()}),
    "onErrorResumeWith": lambda f, failed, other: f.recover_with(F.expr(failed), other),
    "concat": lambda f, other: f.concat(other),
    "processor": lambda f, fn: f.pipe(fn),
    "coupled": lambda f, subscriber, publisher: (f.pipe(subscriber), publisher)[1],
}
TERMINALS = {
    "collect": lambda f, value, name="items": f.collect_list(value, name),
    "findFirst": lambda f, value, name="first": f.collect_first(value, name),
    "forEach": lambda f, fn: [fn(r) for r in f],
    "subscriber": lambda f, **callbacks: f.subscribe(**callbacks),
    "cancel": lambda f: f.ignore(),
}


def _not_null(x):
    if x is None:
        raise NoSuchItem("the future gave null")
    return x


def compile_stages(source: Flow | None, stages: Sequence[tuple], spark: SparkSession | None = None):
    """A flow, or a terminal's result. Without a source the first stage is a publisher.

    A terminal stage must be the last, a publisher the first; an unknown one is an error before anything runs.
    """
    stages = list(stages)
    for i, (name, _) in enumerate(stages):
        begins = source is None and i == 0
        if begins and name not in PUBLISHERS:
            raise ValueError(f"{name} is no publisher")
        if not begins and name not in PROCESSORS and name not in TERMINALS:
            raise ValueError(f"{name} must be the first stage" if name in PUBLISHERS else f"unknown stage {name}")
        if name in TERMINALS and i < len(stages) - 1:
            raise ValueError(f"{name} must be the last stage")
    if source is None:
        (name, args), *stages = stages
        source = PUBLISHERS[name](spark or SparkSession.active(), **args)
    flow = source
    for name, args in stages:
        flow = (PROCESSORS.get(name) or TERMINALS[name])(flow, **args)
    return flow
