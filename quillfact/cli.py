"""Command line: compile a folder of facts into a store, query it, serve it, or try it out."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine, Limits, looks_like_dsl
from .http import serve
from .sources.catalog import Catalog
from .sources.facts import load_kind

HELP = """:predicates  :environment  :describe NAME  :explain QUERY  :validate  :limit N
:core  :dsl  :auto  :load FILE  :loadfacts FILE  :loadqueries FILE  :help  :quit
Queries of several lines and :validate end with an empty line."""

HISTORY_LINES = 1000
SHOWN = 20  # lines of a file that are said to be no facts; ``Catalog.problems`` has all


def _show(out) -> str:
    if out.status == "failed":
        return f"Error [{out.body['code']}]: {out.body['message']}"
    return json.dumps(out.body, indent=2, ensure_ascii=False)


def _told(catalog: Catalog, said: dict[str, str], say) -> None:
    """Say what became of loaded facts, with the first lines that are none."""
    for name, what in said.items():
        say(f"{name}: {what}")
    for path, bad in catalog.problems.items():
        for r in bad.limit(SHOWN).collect():
            say(f"{path}: skipped {r['line']} ({r['problem']})")


def typed(history: str, read=input):
    """Lines from a terminal, edited and recalled by readline where there is one; kept in the file ``history``."""
    try:
        import readline
    except ImportError:
        readline = None
    if readline is not None and os.path.exists(history):
        readline.read_history_file(history)
    try:
        while True:
            try:
                yield read("> ")
            except EOFError:
                return
    finally:
        if readline is not None:
            readline.set_history_length(HISTORY_LINES)
            readline.write_history_file(history)


class Repl:
    """Reads commands and queries from an iterator of lines."""

    def __init__(self, engine: Engine, lines, say=print, limit: int | None = None):
        self.engine, self.lines, self.say, self.mode, self.limit = engine, iter(lines), say, "auto", limit

    def _block(self) -> list[str]:
        out = []
        for line in self.lines:
            if not line.strip():
                break
            out.append(line.rstrip("\n"))
        return out

    def _language(self, text: str) -> str:
        return self.mode if self.mode != "auto" else "dsl" if looks_like_dsl(text) else "core"

    def _file(self, path: str, kind: str) -> None:
        try:
            if kind == "facts":
                said = self.engine.catalog.load_file(path)
                _told(self.engine.catalog, said or {path: "no facts"}, self.say)
                return
            with open(path, encoding="utf-8") as f:
                queries = [s.strip() for s in f if s.strip() and s.strip()[0] not in "%#"]
        except Exception as e:
            self.say(f"Could not read {path}: {e}")
            return
        for q in queries:
            self.say(f"{q}\n{_show(self.engine.run_query(q, limit=self.limit))}")

    def run(self) -> None:
        for line in self.lines:
            if not self.command(line.strip()):
                return

    def command(self, line: str) -> bool:
        """False to end."""
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        if not line:
            return True
        if word in (":quit", ":exit"):
            return False
        if word in (":core", ":dsl", ":auto"):
            self.mode = word[1:]
            self.say(f"mode: {self.mode}")
        elif word == ":help":
            self.say(HELP)
        elif word == ":predicates":
            for p in self.engine.list_predicates()["predicates"]:
                self.say(f"{p['name']}/{p['arity']}")
        elif word == ":environment":
            d = self.engine.describe(names=[])
            self.say(f"{d['environmentFingerprint']} {d['languageVersion']} mode: {self.mode}")
        elif word == ":describe":
            self.say(json.dumps(self.engine.describe(names=[rest])["predicates"], indent=2, ensure_ascii=False))
        elif word == ":limit":
            if rest.isdigit() and int(rest) > 0:
                self.limit = int(rest)
            self.say(f"limit: {self.limit}")
        elif word == ":explain":
            self.say(_show(self.engine.run_query(rest, self._language(rest), "explain")))
        elif word == ":validate":
            if text := "\n".join(self._block()):
                self.say(_show(self.engine.run_query(text, self._language(text), "validate")))
        elif word in (":load", ":loadfacts", ":loadqueries"):
            self._file(rest, load_kind(rest) if word == ":load" else word[5:])
        elif word.startswith(":"):
            self.say(f"Unknown command: {line} (try :help)")
        else:
            language = self._language(line)
            text = "\n".join([line, *self._block()]) if language == "dsl" else line
            self.say(_show(self.engine.run_query(text, language, limit=self.limit if language == "core" else None)))
        return True


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillfact", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compile", help="compile a folder of fact files into a store")
    c.add_argument("source")
    c.add_argument("store")
    for name in ("query", "repl", "serve"):
        s = sub.add_parser(name)
        s.add_argument("store")
        s.add_argument("--config", help="JSON file of limits")
        if name == "query":
            s.add_argument("text")
            s.add_argument("--action", default="execute")
        if name == "repl":
            s.add_argument("--limit", type=int, default=1000, help="rows of a query at most, until :limit says otherwise")
            s.add_argument("--history", default=os.path.join(os.path.expanduser("~"), ".quillfact_history"), help="file of the lines typed")
        if name == "serve":
            s.add_argument("--port", type=int, default=8080)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillfact").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "compile":
        catalog = Catalog(spark)
        said = catalog.compile_folder(given.source)
        catalog.save(given.store)
        _told(catalog, said, print)
        return int(any("mismatch" in what for what in said.values()))
    engine = Engine(Catalog.open(spark, given.store), Limits.load(given.config) if given.config else None)
    if given.command == "query":
        out = engine.run_query(given.text, "dsl" if looks_like_dsl(given.text) else "core", given.action)
        print(_show(out))
        return int(out.status != "ok")
    if given.command == "repl":
        lines = typed(given.history) if sys.stdin.isatty() else sys.stdin
        Repl(engine, lines, limit=given.limit).run()
        if lines is not sys.stdin:
            lines.close()
    else:
        serve(engine, given.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
