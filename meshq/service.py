"""HTTP services on saved indexes: for points, and for sensor records with their payloads. Requests and answers are JSON.

A service's answer() is a plain function of a request; serve() puts it behind the standard library's server. Answers are small: ids
and places, which the driver collects; payloads are read by range.
"""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from meshq.functions.text import parse_ratios, parse_seqs, safe_name, size_in_bytes
from meshq.plans.index import MeshIndex
from meshq.sources import sensors
from meshq.sources.catalog import Catalog, exists
from meshq.sources.points import read_points

RATIOS = "100,50,20"


class Refused(Exception):
    """A request that can't be answered, with its HTTP status."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def parse_body(raw: bytes) -> dict:
    try:
        body = json.loads(raw)
    except ValueError as e:
        raise Refused(400, f"invalid JSON: {e}") from e
    if not isinstance(body, dict):
        raise Refused(400, "the request must be a JSON object")
    return body


def field(body: dict, name: str, kind: str, default=None, required: bool = False):
    """A field of the request: 'text', 'flag', 'number', 'size' (a whole number, 0 or more), 'count' (1 or more) or 'vector'."""
    if name not in body:
        if required:
            raise Refused(400, f"missing field: {name}")
        return default
    v = body[name]
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    whole = number(v) and float(v).is_integer()
    good = {"text": isinstance(v, str), "flag": isinstance(v, bool), "number": number(v), "size": whole and v >= 0, "count": whole and v >= 1, "vector": isinstance(v, list) and all(map(number, v))}[kind]
    if not good:
        raise Refused(400, f"field '{name}' is no {kind}")
    return int(v) if kind in ("size", "count") else [float(x) for x in v] if kind == "vector" else v


def name_field(body: dict, name: str = "dataset_name") -> str:
    try:
        return safe_name(field(body, name, "text", required=True))
    except ValueError as e:
        raise Refused(400, f"invalid {name}") from e


def seqs_field(body: dict) -> list[int]:
    """seq as text ('1', 'seq0001', '1,2'), a number, or an array of both."""
    if "seq" not in body:
        raise Refused(400, "missing field: seq")
    out: set[int] = set()
    for x in body["seq"] if isinstance(body["seq"], list) else [body["seq"]]:
        if isinstance(x, str):
            try:
                out.update(parse_seqs(x))
            except ValueError as e:
                raise Refused(400, str(e)) from e
        elif isinstance(x, int | float) and not isinstance(x, bool) and 0 <= x <= 255:
            out.add(int(x))
        else:
            raise Refused(400, "field 'seq' must hold texts, or numbers of 0 to 255")
    return sorted(out)


class Service:
    """Answers requests; routes are (method, path): handler."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.lock = spark, root.rstrip("/"), threading.Lock()
        self.routes = {}

    def answer(self, method: str, target: str, raw: bytes = b"") -> tuple[int, str, bytes]:
        """Status, content type and body."""
        url = urlsplit(target)
        handler = self.routes.get((method, url.path))
        try:
            if handler is None:
                raise Refused(404, "no such route")
            params = {k: v[0] for k, v in parse_qs(url.query).items()}
            got = handler(params if method == "GET" else raw)
            if isinstance(got, bytes):
                return 200, "application/octet-stream", got
            return 200, "application/json", json.dumps({"success": True, **got}).encode()
        except Refused as e:
            return e.status, "application/json", json.dumps({"success": False, "message": str(e)}).encode()
        except Exception as e:  # noqa: BLE001  any fault of a query is an answer of the service
            return 500, "application/json", json.dumps({"success": False, "message": str(e).splitlines()[0][:500]}).encode()

    def listed(self, names: list[str]) -> dict:
        return {"datasets_count": len(names), "datasets": names}


class PointService(Service):
    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root)
        self.catalog = Catalog(spark, self.root)
        names = lambda _: self.listed(self.catalog.names())
        self.routes = {("POST", "/build-index"): self.build, ("GET", "/datasets"): names, ("POST", "/datasets"): names, ("POST", "/query"): self.query}

    def build(self, raw: bytes) -> dict:
        body = parse_body(raw)
        name = name_field(body)
        if name in self.catalog.names():
            return {"dataset_name": name, "already_exists": True, "message": "the index is there already"}
        path = field(body, "dataset_path", "text", required=True)
        if not path or not exists(self.spark, path):
            raise Refused(400, "dataset_path is no file")
        field(body, "force_cpu", "flag", False)
        try:
            ratios = parse_ratios(field(body, "ratios", "text", RATIOS))
        except ValueError as e:
            raise Refused(400, str(e)) from e
        index = MeshIndex.build(read_points(self.spark, path), "id", "coords", ratios)
        self.catalog.save(name, index)
        index.release()
        return {"dataset_name": name, "already_exists": False, "message": "the index is built and saved"}

    def query(self, raw: bytes) -> dict:
        body = parse_body(raw)
        name = name_field(body)
        kind = field(body, "query_type", "text", required=True).upper()
        if kind not in ("KNN", "RANGE"):
            raise Refused(400, "query_type must be 'KNN' or 'RANGE'")
        if name not in self.catalog.names():
            raise Refused(400, f"no index of {name}")
        with self.lock:
            index = self.catalog.get(name)
        dim = index.dim

        def vector(key: str) -> list[float]:
            v = field(body, key, "vector", required=True)
            if len(v) != dim:
                raise Refused(400, f"{key} must have {dim} numbers")
            return v

        if kind == "KNN":
            point, k = vector("query_point"), field(body, "k", "count", 10)
            found, sizes = index.knn(point, k), index.pruned_sizes(point, k)
        else:
            hi, lo = vector("upper_bound"), vector("lower_bound")
            if any(a > b for a, b in zip(lo, hi, strict=True)):
                raise Refused(400, "a lower bound exceeds its upper bound")
            found, sizes = index.range(lo, hi).select("id").orderBy("id"), index.pruned_sizes(lo=lo, hi=hi)
        began = time.perf_counter()
        ids = [r.id for r in found.collect()]
        us = round((time.perf_counter() - began) * 1e6)
        pruned = [r.n_nodes for r in sizes.orderBy("level").collect()]
        original = [r.n_nodes for r in index.level_sizes().orderBy("level").collect()] + [index.points.count()]
        runtime = {"query_time_us": us, "query_time_ms": us / 1000, "total_time_us": us, "avg_time_us": float(us), "query_count": 1}
        return {"dataset_name": name, "query_type": kind, "result_count": len(ids), "result": ids, "candidate_count": pruned[-1], "memory_policy": "spark", "level_original_sizes": original, "level_pruned_sizes": pruned, "query_runtime": runtime}


class SensorService(Service):
    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root)
        self.loaded: dict[str, sensors.SensorIndex] = {}
        names = lambda _: self.listed(self.names())
        self.routes = {("POST", "/build-index"): self.build, ("GET", "/datasets"): names, ("POST", "/datasets"): names, ("POST", "/query"): self.query, ("GET", "/payload"): self.payload_get, ("POST", "/payload"): self.payload_post}

    def names(self) -> list[str]:
        return Catalog(self.spark, self.root).names(("meta.json",))

    def index(self, name: str) -> sensors.SensorIndex:
        with self.lock:
            if name not in self.loaded:
                if name not in self.names():
                    raise Refused(404, f"no index of {name}")
                self.loaded[name] = sensors.SensorIndex(self.spark, f"{self.root}/{name}")
            return self.loaded[name]

    def build(self, raw: bytes) -> dict:
        body = parse_body(raw)
        name = name_field(body)
        if name in self.names():
            return {"dataset_name": name, "already_exists": True, "message": "the index is there already"}
        root, table = (field(body, k, "text", required=True) for k in ("dataset_root", "csv_path"))
        check = field(body, "verify", "flag", False)
        field(body, "force_cpu", "flag", False)
        slots = field(body, "group_size", "count", 1)
        try:
            most = size_in_bytes(field(body, "max_data_file_size", "text", "1GiB") or "1GiB")
        except ValueError as e:
            raise Refused(400, str(e)) from e
        build_sensors(self.spark, root, table, f"{self.root}/{name}", slots, most, check)
        with self.lock:
            self.loaded.pop(name, None)
        return {"dataset_name": name, "already_exists": False, "message": "the index is built and saved"}

    def query(self, raw: bytes) -> dict:
        body = parse_body(raw)
        name = name_field(body)
        mode = field(body, "mode", "text", "knn").lower()
        if mode not in ("knn", "range"):
            raise Refused(400, f"unsupported mode: {mode}")
        seqs, padding = seqs_field(body), field(body, "include_padding", "flag", False)
        k, limit = field(body, "knn_k", "size", 10), field(body, "range_limit", "size", 0)
        times = {t: field(body, t, "number") for t in ("timestamp", "start", "end")}
        with_url = field(body, "include_payload_url", "flag", True)
        if mode == "knn" and (times["timestamp"] is None or len(seqs) != 1 or k < 1):
            raise Refused(400, "knn needs a timestamp, one sequence, and knn_k of 1 or more")
        if mode == "range" and (times["start"] is None or times["end"] is None or not seqs or times["end"] < times["start"]):
            raise Refused(400, "range needs start, end no earlier than it, and a sequence")
        index = self.index(name)
        if mode == "knn":
            wanted, found = index.knn_candidates(seqs[0], times["timestamp"], k, padding), index.knn(seqs[0], times["timestamp"], k, padding)
        else:
            wanted, found = index.range_candidates(seqs, times["start"], times["end"]), index.range(seqs, times["start"], times["end"], limit, padding)
        rows = [r.asDict() for r in (found.orderBy("rnk") if mode == "knn" else found.orderBy("ts_us", "item_no", "slot")).collect()]
        counts = index.counts(found, wanted, seqs if mode == "range" else None, padding)
        matches = []
        for rank, r in enumerate(rows):
            m = {"rank": rank, "item_no": r["item_no"], "seq": r["seq"], "dtype": r["dtype_id"], "slot": r["slot"], "timestamp": r["ts"], "diff_us": r.get("diff_us", 0), "data_file": r["data_file"], "payload_offset": r["payload_offset"], "payload_size": r["size"]}
            if with_url:
                m["payload_url"] = f"/payload?dataset_name={name}&data_file={r['data_file']}&offset={r['payload_offset']}&size={r['size']}"
            matches.append(m)
        return {"dataset_name": name, "mode": mode, **counts, "matches": matches}

    def payload_get(self, params: dict) -> bytes:
        if any(k not in params for k in ("dataset_name", "data_file", "offset", "size")):
            raise Refused(400, "missing payload parameters")
        if not (params["offset"].isascii() and params["offset"].isdigit() and params["size"].isascii() and params["size"].isdigit()):
            raise Refused(400, "invalid offset or size")
        return self.payload({**params, "offset": int(params["offset"]), "size": int(params["size"])})

    def payload_post(self, raw: bytes) -> bytes:
        return self.payload(parse_body(raw))

    def payload(self, body: dict) -> bytes:
        name, file = name_field(body), name_field(body, "data_file")
        at, size = (field(body, k, "size", required=True) for k in ("offset", "size"))
        index = self.index(name)
        if file not in index.meta["data_files"]:
            raise Refused(404, f"no data file {file}")
        try:
            return index.payload(file, at, size)
        except ValueError as e:
            raise Refused(416, str(e)) from e


def build_sensors(spark: SparkSession, root: str, table: str, path: str, slots: int = 1, most: int = 1 << 30, check: bool = False) -> None:
    """A sensor tree and its coordinate table as one index."""
    records = sensors.read_tree(spark, root, payloads=True).unionByName(sensors.read_coords(spark, table))
    sensors.build(records, path, slots, most, verify=check)


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that answers until shutdown() is called, from a thread of its own."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, body = service.answer(self.command, self.path, raw)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _reply

        def log_message(self, *_args) -> None:
            return

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
