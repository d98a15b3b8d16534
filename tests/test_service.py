import json
import threading
import urllib.request

from quillfact.cli import Repl, main, typed
from quillfact.engine import Engine, Limits
from quillfact.http import get, post, serve
from quillfact.streaming import standing


def make(spark, **kw):
    e = Engine.of(spark, limits=Limits(**({"query_timeout": 60.0} | kw)))
    e.catalog.add_lines("p(a, 1).\np(b, 2).\nq(a).\nday(a, @2020-01-01).")
    return e


def test_routes(spark):
    e = make(spark)
    assert get(e, "/") == (200, {"status": "OK"}) and get(e, "/nothing")[0] == 404
    assert [p["name"] for p in get(e, "/predicates")[1]["predicates"]] == ["day", "p", "q"]
    assert get(e, "/predicates?samples=5")[1]["samples_per_predicate"] == 5
    assert [p["name"] for p in get(e, "/predicates?detailed=1&q=P")[1]["predicates"]] == ["p"]
    assert get(e, "/query/p")[1]["count"] == 2 and get(e, "/query/P!")[0] == 400
    assert post(e, "/query", b"{")[1]["error"]["code"] == "malformed_request" and post(e, "/query", b"[]")[0] == 400 and post(e, "/query", b"{}")[0] == 400
    assert post(e, "/query", json.dumps({"query": "p(X, Y), q(X)"}).encode())[1]["count"] == 1
    assert post(e, "/query", json.dumps({"query": "p(X"}).encode())[0] == 400
    assert post(e, "/query", json.dumps({"query": "day(X, D), D < 3"}).encode()) == (400, {"error": {"code": "execution_error", "message": "date and integer 3 have no common order."}})


def test_busy_and_late(spark):
    e = make(spark, max_concurrent_queries=1)
    e._slots.acquire()
    assert post(e, "/query", b'{"query": "q(X)"}')[0] == 429
    e._slots.release()
    assert post(make(spark, query_timeout=0.001), "/query", b'{"query": "p(X, Y), q(X)"}')[1]["error"]["code"] == "timeout"


def test_over_the_wire(spark):
    server = serve(make(spark), 0, "127.0.0.1")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{url}/version"))["name"] == "quillfact"
    asked = urllib.request.Request(f"{url}/query", json.dumps({"query": "find X\nwhere\nq(X)", "language": "dsl"}).encode())
    assert json.load(urllib.request.urlopen(asked))["results"] == [{"X": {"type": "atom", "value": "a"}}]
    server.shutdown()


def test_repl(spark, tmp_path):
    (tmp_path / "more.pl").write_text("z(k).\n")
    said = []
    lines = [":predicates", ":limit 1", "p(X, Y)", "find X", "where", "q(X)", "", ":explain q(X)", ":validate", "q(X", "", f":load {tmp_path}/more.pl", ":dsl", ":core", ":auto", ":environment", ":describe p", ":help", ":odd", ":quit", "q(X)"]
    Repl(make(spark), lines, said.append).run()
    text = "\n".join(said)
    assert "p/2" in text and '"count": 1' in text and "syntax_error" in text and "z: written" in text and "Unknown command" in text and "full_scan" in text
    assert said[-1].startswith("Unknown command")


def test_typed_lines_are_kept(spark, tmp_path):
    import readline

    given, said = iter(["p(X, Y)", ":quit", "q(X)"]), []

    def read(prompt):
        line = next(given)
        readline.add_history(line)
        return line

    lines = typed(str(tmp_path / "history"), read)
    Repl(make(spark), lines, said.append, limit=1).run()
    lines.close()
    assert '"count": 1' in said[0] and len(said) == 1
    assert (tmp_path / "history").read_text().split("\n")[-3:] == ["p(X, Y)", ":quit", ""]


def test_compile_and_query(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "p.pl").write_text("p(a).\np(b).\n")
    assert main(["compile", str(tmp_path / "src"), str(tmp_path / "store")]) == 0
    assert main(["query", str(tmp_path / "store"), "p(X)"]) == 0
    assert '"count": 2' in capsys.readouterr().out


def test_standing_query(spark, tmp_path):
    e = make(spark)
    spark.createDataFrame([("a", 5), ("c", 6)], "k string, v long").write.parquet(f"{tmp_path}/in")
    e.catalog.register("live", spark.readStream.schema("k string, v long").parquet(f"{tmp_path}/in"), kinds={"k": "atom"}, distinct=False)
    stream = standing(e, "live(X, V), p(X, Y), V > Y").writeStream.format("memory").queryName("live_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert [tuple(r) for r in spark.table("live_out").collect()] == [(5, "a", 1)]
