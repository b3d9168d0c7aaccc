"""Files that runs leave and later runs find: path resolution, folders of mixed examples, calibrators, the latest artifact.

Lists of files are the driver's business and go through Hadoop's file systems, so they work on any storage; what is in example files is
read by the executors.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as cal
from . import readers

#: The kinds of example files that a folder may hold.
KINDS = {"jsonl": ".jsonl", "json": ".json", "csv": ".csv", "parquet": ".parquet"}


def resolved(path: str, roots: tuple[str, ...] = ()) -> str:
    """A path with its variables and ~ replaced; a relative one that is not here is looked for under roots. URIs stay as they are."""
    path = os.path.expanduser(os.path.expandvars(path))
    if "://" in path or os.path.isabs(path) or os.path.exists(path):
        return path
    return next((str(Path(r) / path) for r in roots if (Path(r) / path).exists()), path)


def listed(spark: SparkSession, folder: str, *suffixes: str) -> list[tuple[str, int]]:
    """(path, time of the last change in ms) of the files under a folder, at any depth, whose names end so; in order of path; none without the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    if fs.exists(at):
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(suffixes):
                out.append((f.getPath().toString(), f.getModificationTime()))
    return sorted(out)


def latest(spark: SparkSession, folder: str, *suffixes: str) -> str | None:
    """The file that was changed last, of equally new ones the last by path."""
    found = listed(spark, folder, *suffixes)
    return max(found, key=lambda f: (f[1], f[0]))[0] if found else None


def scan_folder(spark: SparkSession, folder: str) -> DataFrame | None:
    """The examples of all JSON lines, JSON, CSV and Parquet files under a folder; None where there are none."""
    parts = []
    for kind, suffix in KINDS.items():
        paths = [p for p, _ in listed(spark, folder, suffix)]
        if paths and kind == "jsonl":
            parts.append(readers.examples(readers.scan_jsonl(spark, paths)))
        elif paths and kind == "json":
            parts.append(readers.examples(readers.scan_json(spark, paths)))
        elif paths and kind == "parquet":  # through the same rules as JSON, columns of any type
            parts.append(readers.examples(spark.read.option("mergeSchema", "true").parquet(*paths).select(F.parse_json(F.to_json(F.struct("*"))).alias("record"))))
        else:  # headers may differ from file to file
            parts += [readers.scan_csv(spark, p) for p in paths]
    return readers.union(*parts) if parts else None


def tag(name: str) -> str:
    """A name as part of a file name: runs of other marks than letters, digits, dots and hyphens become one underscore."""
    return re.sub(r"[^A-Za-z0-9.-]+", "_", name).strip("_")


def saved(spark: SparkSession, model: cal.Platt | cal.Linear, folder: str, detector: str, scorer: str) -> str:
    """Writes a calibrator of a detector's scores under a scoring model, and returns the path."""
    path = f"{folder.rstrip('/')}/{tag(detector)}__{tag(scorer)}.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(json.dumps({"detector": detector, "model": scorer, "calibrator": vars(model)}).encode()))
    finally:
        stream.close()
    return path


def calibrator(doc: object) -> cal.Platt | cal.Linear | None:
    """The calibrator of a document, of this library's layout or of the older ones; None if it holds none.

    The coefficients are beta0 and beta1, or a list beta; mean and std count unless standardize is false, and a deviation of 0 is 1. The
    decision's threshold is the calibrator's own, else that of the evaluation that the document reports, else a half.
    """
    own = doc.get("calibrator") if isinstance(doc, dict) else None
    if not isinstance(own, dict):
        return None
    meta = doc.get("meta") if isinstance(doc.get("meta"), dict) else {}
    reported = meta.get("dev_eval") if isinstance(meta.get("dev_eval"), dict) else {}
    try:
        at = next((float(x) for x in (own.get("decision_threshold"), reported.get("threshold_prob")) if x is not None), 0.5)
        scaled = own.get("standardize", True)
        if isinstance(own.get("beta"), list):
            beta = [float(x) for x in own["beta"]]
            mean = [float(x) for x in own.get("mean") or []] if scaled else []
            std = [float(x) or 1.0 for x in own.get("std") or []] if scaled else []
            if not scaled:
                mean, std = [0.0] * (len(beta) - 1), [1.0] * (len(beta) - 1)
            return cal.Linear(beta, mean, std, own.get("name", "linear_lr"), at) if beta else None
        mean, std = (float(own.get("mean") or 0.0), float(own.get("std") or 1.0)) if scaled else (0.0, 1.0)
        return cal.Platt(float(own["beta0"]), float(own["beta1"]), mean, std, own.get("name", "platt_lr"), at)
    except (KeyError, TypeError, ValueError):
        return None


def loaded(spark: SparkSession, path: str) -> tuple[dict, cal.Platt | cal.Linear]:
    """A calibrator's document and the calibrator; ValueError if the file is none."""
    try:
        doc = json.loads(spark.read.text(path, wholetext=True).first().value)
    except (AttributeError, json.JSONDecodeError) as e:  # empty, or no JSON
        raise ValueError(f"{path} is no calibrator") from e
    model = calibrator(doc)
    if model is None:
        raise ValueError(f"{path} is no calibrator")
    return doc, model


def _plain(name: object) -> str:
    """Letters and digits of the last part of a name or path, in lower case, without a closing detector."""
    last = re.split(r"[/\\]", str(name or "").strip().rstrip("/\\"))[-1].lower()
    return re.sub(r"detector$", "", re.sub(r"[^a-z0-9]+", "", last))


def described(path: str, doc: dict) -> tuple[set[str], set[str]]:
    """Names of the detector and of the models that a calibrator is for: from the document, and from the parts of its file's name."""
    meta = doc.get("meta") if isinstance(doc.get("meta"), dict) else {}
    detector, _, inside = str(meta.get("detector") or "").partition("[")
    models = meta.get("models") if isinstance(meta.get("models"), dict) else {}
    parts = path.rsplit("/", 1)[-1].removesuffix(".json").split("_")
    named = {_plain(x) for x in (doc.get("model"), *inside.rstrip("]").split("|"), *models.values(), *parts)}
    return {_plain(x) for x in (doc.get("detector"), detector, *parts)} - {""}, named - {""}


def discovered(spark: SparkSession, detector: str, scorer: str, folders: tuple[str, ...], explicit: str | None = None) -> tuple[str, cal.Platt | cal.Linear] | None:
    """The calibrator at an explicit path, or of the first of folders that has one for the detector or the model: 2 for the detector, 1 for
    the model, and of equal ones the newest. Files that are no calibrators are passed over."""
    if explicit:
        return explicit, loaded(spark, explicit)[1]
    for folder in folders:
        found = []
        for path, changed in listed(spark, folder, ".json"):
            try:
                doc, model = loaded(spark, path)
            except ValueError:
                continue
            detectors, models = described(path, doc)
            score = 2 * (_plain(detector) in detectors) + (_plain(scorer) in models)
            if score:
                found.append((score, changed, path, model))
        if found:
            _, _, path, model = max(found, key=lambda f: f[:3])
            return path, model
    return None
