"""python -m docgraph.cli [--root DIR] setup | <file> [--dry-run] [--no-embed] | backfill | index | stats | reset | search [--passages] <question> | chat | serve"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import SparkSession

from .errors import DocgraphError
from .http_provider import providers_from_env
from .service import Engine, serve
from .sources.readers import read_files


def main(argv: list[str] | None = None, engine: Engine | None = None, ask=input) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    root = os.environ.get("KG_ROOT", "docgraph-store")
    if "--root" in args:
        i = args.index("--root")
        root = args[i + 1]
        del args[i : i + 2]
    flags = {a for a in args if a in ("--dry-run", "--no-embed", "--passages")}
    words = [a for a in args if a not in flags]
    if not words:
        print(__doc__)
        return 0
    engine = engine or Engine(SparkSession.builder.appName("docgraph").getOrCreate(), root, **providers_from_env())
    show = lambda x: print(json.dumps(x, indent=2, default=str, ensure_ascii=False))
    try:
        match words[0]:
            case "setup":
                show(engine.setup())
            case "stats":
                show(engine.stats())
            case "backfill":
                show(engine.backfill())
            case "index":
                show(engine.index())
            case "reset":
                if ask("Delete all Documents, Chunks and Entities? [y/N] ").strip().lower() != "y":
                    print("Cancelled.")
                else:
                    show(engine.reset())
            case "search":
                if len(words) < 2:
                    print(__doc__)
                    return 0
                passages = "--passages" in flags  # no model is asked for an answer then
                found = engine.search(" ".join(words[1:]), with_answer=not passages)
                show({k: v for k, v in found.items() if k != "answer" or not passages})
            case "chat":
                while True:
                    try:
                        question = ask("You: ").strip()
                    except (EOFError, KeyboardInterrupt):
                        break
                    if question.lower() in ("", "quit", "exit", "q"):
                        break
                    show(engine.chat(question))
                print("Bye!")
            case "serve":
                serve(engine).serve_forever()
            case path:
                if "--dry-run" in flags:
                    show(engine.dry_run(read_files(engine.spark, path)))
                else:
                    show(engine.ingest_paths(path, with_embeddings="--no-embed" not in flags))
    except DocgraphError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
