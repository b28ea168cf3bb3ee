"""The command line, the pages and the tools."""

import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from heaplake import __main__ as cli
from heaplake.facade import Analysis, parse_id
from heaplake.model import Heap
from heaplake.server import TOOLS, handler, page, rpc

from . import fixtures as fx


@pytest.fixture(scope="module")
def analysis(spark):
    h = Heap.from_bytes(spark, fx.f2())
    h.dominator, h.retained  # noqa: B018 - builds both
    return Analysis(h, Heap.from_bytes(spark, fx.f4()), "a dump")


PAGES = ["/", "/allClasses", "/histogram", "/class/0x50", "/instances/0x10", "/object/0x400", "/object/0x300/raw-string", "/object/0x200/raw-array", "/object/0x400/root-path", "/arrays/char", "/roots",
         "/roots/sticky_class", "/threads", "/thread/1", "/retained", "/diff", "/diff/removed", "/diff/added?class=0x100", "/diff/common?changed=1", "/diff/object/0x100"]


@pytest.mark.parametrize("path", PAGES)
def test_pages(analysis, path):
    path, _, query = path.partition("?")
    assert page(analysis, path, dict([query.split("=")]) if query else {})


def test_page_contents(analysis):
    assert page(analysis, "/object/300/raw-string", {}) == "hi"
    assert page(analysis, "/object/200/raw-array", {}) == "&#x27;h&#x27;, &#x27;i&#x27;"
    assert "NotReachable" in page(analysis, "/object/0x400/root-path", {})
    assert "count" in page(analysis, "/class/0x50", {})


ARGS = {"find_object": {"id": "0x100"}, "find_class_by_name": {"name": "Integer"}, "back_references": {"id": "0x100"}, "gc_roots": {"type": "jni_local"}, "resolve_string": {"id": "300"}, "dominator_info": {"id": "0x100"}}


@pytest.mark.parametrize("tool", TOOLS)
def test_tools(analysis, tool):
    reply = rpc(analysis, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": ARGS.get(tool, {})}})
    text = reply["result"]["content"][0]["text"]
    want = {"find_object": '"42"', "find_class_by_name": "java.lang.Integer", "back_references": "0x400", "resolve_string": "hi"}
    assert want.get(tool, "") in text


def test_rpc_errors(analysis):
    def code(request):
        return rpc(analysis, request)["error"]["code"]

    assert code({"id": 1}) == -32600
    assert code({"jsonrpc": "2.0", "id": 1, "method": "x"}) == -32601
    assert code({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {}}) == -32602
    assert code({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "find_object"}}) == -32603
    unknown = rpc(analysis, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "nope"}})
    assert unknown["result"]["content"][0]["text"].startswith("Unknown tool")
    assert len(rpc(analysis, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"})["result"]["tools"]) == 10
    assert rpc(analysis, {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None


def test_http(analysis):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(analysis))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert b"java.lang.Integer" in urllib.request.urlopen(f"{base}/histogram").read()
    for path, status in (("/nope", 404), ("/arrays/none", 400), ("/object/zz", 400), ("/object/0x999", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + path)
        assert e.value.code == status
    request = urllib.request.Request(f"{base}/mcp", json.dumps({"jsonrpc": "2.0", "id": 7, "method": "ping"}).encode())
    assert json.loads(urllib.request.urlopen(request).read()) == {"jsonrpc": "2.0", "id": 7, "result": {}}
    server.shutdown()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    a, b = tmp_path / "a.hprof", tmp_path / "b.hprof"
    a.write_bytes(fx.f2())
    b.write_bytes(fx.f4())
    assert cli.main(["index", f"--hprof={a}"]) == 0
    assert (tmp_path / "a.indexes" / "instance" / "_SUCCESS").exists()
    assert cli.main(["diff", "-f", str(a), "--diff-hprof", str(b)]) == 0
    assert (tmp_path / "a_vs_b.diff_indexes" / "entries" / "_SUCCESS").exists()
    assert cli.main(["query", "-f", str(a), "--sql", "select count(*) n from instance"]) == 0
    assert "3" in capsys.readouterr().out
    for bad in (["index", "-f", str(tmp_path / "none.hprof")], ["diff", "-f", str(a)], []):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_ids():
    assert parse_id("0xFF") == parse_id("ff") == 255
    assert parse_id("f000000000000000") == -(1 << 60)
    with pytest.raises(ValueError):
        parse_id("xyz")
