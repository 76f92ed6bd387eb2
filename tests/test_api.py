"""The paged source: fixtures, retries, settings, and an HTTP server of its own."""

import http.server
import json
import threading

import pytest

from pulsefield.sources import api


def save(folder, action, pages):
    for i, data in enumerate(pages, 1):
        (folder / f"{action}_{i}.json").write_text(json.dumps({"pages": len(pages), "data": data}))


def test_a_partition_a_page(spark, tmp_path):
    save(tmp_path, "x", [[{"id": i * 10 + k, "n": "é"} for k in range(3)] for i in range(4)])
    rows = api.read_api(spark, "x", fixtures=str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4
    got = api.columns_of(rows, "id long, n string, later string").collect()
    assert sorted(r.id for r in got) == [i * 10 + k for i in range(4) for k in range(3)] and {(r.n, r.later) for r in got} == {("é", None)}
    (tmp_path / "one_1.json").write_text('{"data": {"total": 3}}')
    (tmp_path / "none_1.json").write_text('{"data": null}')
    assert [json.loads(r.payload) for r in api.read_api(spark, "one", fixtures=f"file://{tmp_path}").collect()] == [{"total": 3}]
    assert api.read_api(spark, "none", fixtures=str(tmp_path)).count() == 0


def test_failures_are_tried_again_and_then_told(spark, tmp_path):
    save(tmp_path, "x", [[{"id": 1}], [{"id": 2}]])
    for attempt in (0, 1):
        (tmp_path / f"x_2.failed{attempt}").write_text("")
    waits = []
    options = {"action": "x", "fixtures": str(tmp_path), "retries": "2", "wait": "1"}
    assert api.fetch(options, 2, waits.append)["data"] == [{"id": 2}] and waits == [1, 2]
    with pytest.raises(api.ApiError, match="x, page 2"):
        api.fetch(options | {"retries": "1"}, 2, waits.append)
    assert api.read_api(spark, "x", fixtures=str(tmp_path), wait=0).count() == 2
    with pytest.raises(Exception, match="x, page 2"):
        api.read_api(spark, "x", fixtures=str(tmp_path), retries=1, wait=0).count()
    (tmp_path / "list_1.json").write_text("[1]")
    with pytest.raises(api.ApiError, match="kind list"):
        api.fetch(options | {"action": "list", "retries": "0"}, 1)
    with pytest.raises(api.ApiError, match="must be set"):
        api.fetch({"action": "x"}, 1)


def test_over_http(spark):
    asked = []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            page = int(self.path.rsplit("page=", 1)[1])
            broken = page == 2 and sum("page=2" in p for p in asked) == 1
            self.send_response(500 if broken else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"pages": 2, "data": [{"page": page}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = api.read_api(spark, "w", base_url=f"http://127.0.0.1:{server.server_port}/", secret="s", params={"course_id": 7}, wait=0).collect()
    finally:
        server.shutdown()
    assert sorted(json.loads(r.payload)["page"] for r in rows) == [1, 2]
    assert all("ld_api=w" in p and "course_id=7" in p and "secret=s" in p for p in asked)
