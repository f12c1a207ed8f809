"""Python -m brindle --config FILE (--build-only | --status | --search QUERY)."""

from __future__ import annotations

import argparse
import sys
import time

from .plans.config import ConfigError, load_config
from .plans.service import Engine, ServiceError
from .plans.tools import Tools, bytes_text
from .session import session


def main(args: list[str] | None = None) -> int:
    """0 if all went well, else 1."""
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("--config")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--build-only", action="store_true")
    what.add_argument("--status", action="store_true")
    what.add_argument("--search")
    a = p.parse_args(args)
    try:
        config = load_config(a.config)
        engine = Engine(session(), config)
    except (ConfigError, ServiceError, ValueError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 1
    if a.search:
        print(Tools(engine).code_search(a.search))
        return 0
    failed = 0
    for name, own in engine.indexes.items():
        began = time.perf_counter()
        try:
            if a.build_only:
                own.rebuild()
            s = own.status()
            took = time.perf_counter() - began
            began = time.perf_counter()
            own.search("index", 5)
            print(f"{name}: {s['files']} files, {s['chunks']} chunks, generation {s['generation']}, {bytes_text(s['bytes'])}, {took:.1f} s, a query {time.perf_counter() - began:.1f} s")
        except Exception as e:
            failed += 1
            print(f"{name}: {e}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
