"""Command line: encode, decode, verify, info, search, anomaly, episode-compress, export-tokens, audit-bundle.

Any failure is one line on standard error and exit code 1.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace import __version__
from kinetrace.operators import anomaly, frames, search, tokens
from kinetrace.sources import bags, files, packets, wire


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _write(path: str, content: bytes) -> None:
    with open(path, "wb") as f:
        f.write(content)


def _say(value: dict) -> None:
    print(json.dumps(value, indent=2, sort_keys=True))


def _library(spark: SparkSession, folder: str) -> DataFrame:
    """(traj_id, path, joint, frame, x) of all packets below a folder, numbered by path; a bad packet is an error."""
    paths = [r["path"] for r in packets.read_packets(spark, folder).select("path").orderBy("path").collect()] if os.path.isdir(folder) else []
    if not paths:
        raise ValueError(f"no packets in {folder}")
    names = spark.createDataFrame(list(enumerate(paths)), "traj_id bigint, path string")
    cells = packets.unpack_frames(packets.read_packets(spark, folder), "path").join(names, "path")
    wrong = cells.where("error is not null").select("path", "error").head(1)
    if wrong:
        raise ValueError(f"{wrong[0]['path']}: {wrong[0]['error']}")
    return cells


def _wide(cells: DataFrame) -> DataFrame:
    joints = cells.agg(F.max("joint")).first()[0] + 1
    return cells.groupBy("traj_id", "frame").agg(*[F.max(F.when(F.col("joint") == j, F.col("x"))).alias(f"x{j}") for j in range(joints)])


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.input.lower().endswith(".csv"):
        blob = wire.encode(files.parse_csv(_read(a.input).decode("utf-8")))
    else:
        records = bags.read_bag(_read(a.input))
        if len(records) != 1:
            raise ValueError(f"the bag has {len(records)} records; one is expected")
        blob = wire.encode(wire.decode(records[0]["blob"]))
    _write(a.output, blob)


def decode(spark: SparkSession, a: argparse.Namespace) -> None:
    blob = _read(a.input)
    x = wire.decode(blob)
    if a.output.lower().endswith(".csv"):
        lines = [",".join(f"joint_{j}" for j in range(x.shape[1])), *(",".join(map(repr, map(float, r))) for r in x)]
        _write(a.output, ("\n".join(lines) + "\n").encode())
    else:
        _write(a.output, bags.write_json([bags.record(0, blob, joint_names=[f"joint_{j}" for j in range(x.shape[1])])]))


def verify(spark: SparkSession, a: argparse.Namespace) -> None:
    blob = _read(a.input)
    _say(wire.describe(blob) | {"crc_ok": True, "sha256": hashlib.sha256(blob).hexdigest()})


def info(spark: SparkSession, a: argparse.Namespace) -> None:
    h = wire.header(_read(a.input))
    _say({"wire_version": h.version, "frames": h.frames, "joints": h.joints, "keep_coeffs": h.keep, "payload_values": h.values, "header_ok": True})


def find(spark: SparkSession, a: argparse.Namespace) -> None:
    number = search.template_number(a.template)
    cells = _library(spark, a.folder)
    path = frames.planar(_wide(cells))
    index = search.features(frames.resample(path, search.PROTOTYPE_FRAMES))
    asked = search.features(search.prototype_frames(spark, (search.LABELS[number],)))
    found = search.template_search(index, asked).join(cells.select("traj_id", "path").distinct(), "traj_id").orderBy("rank").collect()
    rows = [{"file": os.path.basename(r["path"]), "label": os.path.basename(r["path"]).rsplit(".", 1)[0].rsplit("_", 1)[0], "score": r["score"]} for r in found]
    _say({"template": a.template.upper(), "results": rows})


def detect(spark: SparkSession, a: argparse.Namespace) -> None:
    blob, asked = _read(a.query), os.path.realpath(a.query)
    cells = _library(spark, a.folder).withColumn("is_query", F.regexp_replace("path", "^file:/*", "/") == asked)
    fleet = cells.where("not is_query")
    if not fleet.head(1):
        raise ValueError("the fleet is empty")
    x = wire.decode(blob)
    one = spark.createDataFrame([(0, f, *map(float, r)) for f, r in enumerate(x)], "traj_id bigint, frame bigint, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))
    wide = _wide(fleet)
    if frames.joint_count(wide) != x.shape[1]:
        raise ValueError("the query has another number of joints than the fleet")
    model = anomaly.fit_fleet(tokens.token_histogram(tokens.joint_tokens(wide)))
    r = anomaly.score_fleet(tokens.token_histogram(tokens.joint_tokens(one)), model, a.threshold).first()
    print(f"{'ANOMALY' if r['flagged'] else 'NORMAL'} z_score={r['score']:.6f}")


def compress(spark: SparkSession, a: argparse.Namespace) -> None:
    done = files.compress_episodes(files.read_episodes(spark, a.folder)).cache()
    wrong = done.where("error is not null").head(1)
    if wrong or not done.head(1):
        raise ValueError(f"{wrong[0]['path']}: {wrong[0]['error']}" if wrong else "no episode files")
    os.makedirs(a.output, exist_ok=True)
    base = os.path.realpath(a.folder)
    for r in done.toLocalIterator():
        at = os.path.join(a.output, os.path.relpath(r["path"].removeprefix("file:"), base))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        _write(at + ".packet", bytes(r["content"]))
        _write(at + ".packet.json", r["sidecar"].encode())
    _say(files.overall_ratio(done).first().asDict())


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    x = wire.decode(_read(a.input))
    wide = spark.createDataFrame([(0, f, *map(float, r)) for f, r in enumerate(x)], "traj_id bigint, frame bigint, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))
    r = tokens.export_tokens(wide).first()
    _say({"tokens": r["tokens"]} | ({"timestamps": r["timestamps"], "joint_names": r["joint_names"]} if a.format == "vla" else {}))


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    blob = _read(a.input)
    x = wire.decode(blob)
    os.makedirs(a.output, exist_ok=True)
    cases = [{"case_id": n, "mutation": what, "expected_failure": said, "actual_failure": wire.failure(change(blob))} for n, what, said, change in wire.CORRUPTIONS]
    cases = [c | {"status": "PASS" if c["expected_failure"] == c["actual_failure"] else "FAIL"} for c in cases]
    again = bags.round_trip([bags.record(0, blob)], "json")
    manifest = {"packet_sha256": hashlib.sha256(blob).hexdigest(), "packet_info": wire.describe(blob), "decoded_shape": list(x.shape), "replay": again, "status": "PASS" if again["bytes_equal"] else "FAIL"}
    for name, value in (("manifest.json", manifest), ("corruption_matrix.json", {"cases": cases, "status": "PASS" if all(c["status"] == "PASS" for c in cases) else "FAIL"})):
        _write(os.path.join(a.output, name), (json.dumps(value, indent=2, sort_keys=True) + "\n").encode())
    _say(manifest)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinetrace")
    top.add_argument("--version", version=__version__, action="version")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *names: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        p.set_defaults(run=run)
        return p

    add("encode", encode, "input", "output")
    add("decode", decode, "input", "output")
    add("verify", verify, "input")
    add("info", info, "input")
    add("search", find, "folder", "template")
    add("anomaly", detect, "folder", "query").add_argument("--threshold", type=float, default=anomaly.BASELINE)
    add("episode-compress", compress, "folder", "output")
    add("export-tokens", export, "input").add_argument("--format", required=True, choices=("vla", "fast"))
    add("audit-bundle", audit, "input", "output")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        if spark is None and a.run in (find, detect, compress, export):
            from kinetrace.session import session

            spark = session("kinetrace-cli")
        a.run(spark, a)
    except Exception as e:  # noqa: BLE001 - the command line reports any failure in one line
        print(f"error: {e}".splitlines()[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
