"""``python -m tessera.cli inspect DIR`` prints the newest manifest's fields and changes nothing."""

from __future__ import annotations

import sys
from pathlib import Path

from tessera.errors import EngineError
from tessera.sources.store import Store


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "inspect":
        print("usage: inspect DIR", file=sys.stderr)
        return 1
    if not (Path(args[1]) / "_log").is_dir():
        print(f"{args[1]} holds no database", file=sys.stderr)
        return 1
    try:
        made = Store(args[1], read_only=True).latest()
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"version: {made['version']}")
    for t in made["tables"].values():
        print(f"table {t['name']}: {', '.join(f'{c} {k}' for c, k in t['columns'])}; {len(t['parts'])} parts, next row {t['next']}")
    for i in made["indexes"].values():
        print(f"{'unique ' * i['unique']}index {i['name']}: {i['table']} ({', '.join(i['columns'])})")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
