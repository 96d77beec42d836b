"""The REST sources against a local server."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from trackloom.sources import rest


class Service(BaseHTTPRequestHandler):
    def answer(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
        self.answer(200, {"access_token": "t-" + form["client_secret"][0], "expires_in": 60}) if form["client_id"] == ["me"] else self.answer(401, {})

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        if self.headers.get("Authorization") != "Bearer t-key":
            return self.answer(401, {})
        if url.path == "/tracks":
            return self.answer(200, {"callsign": "thy1 ", "path": [[10, 40.0, 30.0, 900.0], [20, None, 30.0, 1.0], [30, 41.0, 31.0, None]]}) if q["icao24"] == "aa" else self.answer(404, {})
        at = int(q.get("time", 0))
        if at == 600:
            return self.answer(503, {})
        self.answer(200, {"states": [["BB", "thy22 ", "x", None, 1, 30.5, 40.5, 1000.0], ["cc", "KLM1", "x", at, 1, None, 40.5, 1.0]]})

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_tracks_states_and_lookup(spark, url):
    spark.dataSource.register(rest.TrackSource)
    spark.dataSource.register(rest.StateSource)
    own = {"token_url": url + "/token", "client_id": "me", "client_secret": "key"}
    tracks = spark.read.format("rest_tracks").options(url=url + "/tracks", icao24="AA, bb", **own).load()
    assert sorted(map(tuple, tracks.collect())) == [("aa", "THY1", 10.0, 40.0, 30.0, 900.0), ("aa", "THY1", 30.0, 41.0, 31.0, 0.0)]
    states = spark.read.format("rest_states").options(url=url + "/states", begin="300", end="900", **own).load()
    # three moments, of which one fails; states without a position are left out
    assert sorted(map(tuple, states.collect())) == [("bb", "THY22", 300.0, 40.5, 30.5, 1000.0), ("bb", "THY22", 900.0, 40.5, 30.5, 1000.0)]
    assert rest.find_icao24(states, "hy2").first().icao24 == "bb" and rest.find_icao24(states, "nobody").first() is None
    both = rest.tracks_or_states(tracks, states)
    assert {(r.icao24, r.time_unix) for r in both.collect()} == {("aa", 10.0), ("aa", 30.0), ("bb", 300.0), ("bb", 900.0)}


def test_refusals_are_errors(spark, url):
    spark.dataSource.register(rest.TrackSource)
    spark.dataSource.register(rest.StateSource)
    with pytest.raises(Exception, match="401"):
        spark.read.format("rest_tracks").options(url=url + "/tracks", icao24="aa", token="wrong").load().collect()
    assert spark.read.format("rest_states").options(url=url + "/states", token="wrong").load().count() == 0
    with pytest.raises(Exception, match="401"):
        spark.read.format("rest_states").options(url=url + "/states", token="wrong", strict="true").load().collect()


def test_token_is_fetched_again_before_it_ends():
    clock, asked = [0.0], []

    def fetch(u, form):
        asked.append(form["client_id"])
        return 200, json.dumps({"access_token": f"t{len(asked)}", "expires_in": 100})

    token = rest.Token("u", "me", "s", fetch, lambda: clock[0])
    assert token.get() == token.get() == "t1"
    clock[0] = 41.0
    assert token.get() == "t2"
