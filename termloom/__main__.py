"""Run a flow: ``python -m termloom flow.json [--env env.json] [--out folder] [--set node.param=value ...]``.

The environment names sources and guides. Model names of the form
``module:callable`` are imported.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="termloom")
    p.add_argument("flow")
    p.add_argument("--env")
    p.add_argument("--out")
    p.add_argument("--set", action="append", default=[], metavar="NODE.PARAM=VALUE")
    p.add_argument("--check", action="store_true", help="validate only")
    a = p.parse_args(argv)

    from pyspark.sql import DataFrame

    from .plans import config, flow, functions  # noqa: F401
    from .session import local_session

    env = config.read_json(a.env) if a.env else {}
    spec = config.override(config.read_json(a.flow), dict(x.split("=", 1) for x in a.set))
    models = {}
    for name, where in env.get("models", {}).items():
        module, _, attribute = where.partition(":")
        models[name] = getattr(importlib.import_module(module), attribute)
    spark = local_session()
    nodes, ctx = config.assemble(spark, spec, env, models)
    if a.check:
        flow.validate(nodes, ctx)
        return 0
    failed = 0
    for node, result in flow.run(nodes, ctx).items():
        shown = {}
        for port, value in result.outputs.items():
            if isinstance(value, DataFrame):
                if a.out:
                    value.write.mode("overwrite").parquet(f"{a.out}/{node}-{port}")
                shown[port] = value.columns
            elif isinstance(value, (str, float, int)):
                shown[port] = value
        failed += not result.ok
        print(json.dumps({"node": node, "ok": result.ok, "error": result.error, "outputs": shown}, ensure_ascii=False))
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
