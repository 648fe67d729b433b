"""python -m quarry build FOLDER STORE | search STORE TEXT... | ask STORE

``ask`` reads one question a line until the input ends or Ctrl+C."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import functions as F

from .config import EngineConfig
from .operators.output import summary
from .plans.engine import Engine
from .providers import HttpGenerator
from .session import build_session


def talk(engine: Engine, lines: Iterable[str], say=print) -> None:
    """The best chunks of each line that is not blank, with source, page, id, metadata and context."""
    for line in lines:
        if not line.strip():
            continue
        rows = engine.answer(line.strip()).where("rank <= 3").orderBy("rank").collect()  # at most three
        if not rows:
            say("nothing found")
        for r in rows:
            say(f"{r['rank']}. {r['source']}, page {r['page']}, {r['id']}")
            known = [f"{n}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for n in ("geo", "years", "metrics", "time_granularity", "oked") if (v := r[n])]
            if known:
                say("   " + "; ".join(known))
            say(f"   {r['context']}")


def main(args: list[str]) -> None:
    cfg = EngineConfig()
    needs = {"build": len(args) == 3, "search": len(args) > 2, "ask": len(args) == 2}
    if not args or not needs.get(args[0]):
        sys.exit(__doc__)
    engine = Engine(build_session(), args[-1] if args[0] == "build" else args[1], cfg, HttpGenerator(cfg.generator))
    if args[0] == "build":
        engine.build(args[1])
    elif args[0] == "search":
        summary(engine.answer(*args[2:])).orderBy(F.col("query_id"), F.col("rank")).show(truncate=False)
    else:
        try:
            talk(engine, sys.stdin)
        except KeyboardInterrupt:
            pass


if __name__ == "__main__":
    main(sys.argv[1:])
