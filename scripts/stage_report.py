"""Per-stage numbers from a Spark event log (no UI, no server).

    python scripts/stage_report.py <event log file or eventlog_v2_* directory>

Run a job with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir`` set
to a scratch folder, label it with ``sparkContext.setJobDescription``, then
print per stage: job description, input rows, shuffle records/bytes written
and run time. Handles plain and zstd-compressed logs.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for f in files:
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                import zstandard
                stream = zstandard.ZstdDecompressor().stream_reader(fh)
            else:
                stream = fh
            yield from io.TextIOWrapper(stream, encoding="utf-8")


def stage_rows(path: str) -> list[dict]:
    desc_of, rows = {}, []
    for line in _lines(path):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            d = e.get("Properties", {}).get("spark.job.description")
            for sid in e["Stage IDs"]:
                desc_of[sid] = d
        elif e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            acc = {a["Name"]: a.get("Value") for a in si.get("Accumulables", [])}
            rows.append({
                "stage": si["Stage ID"],
                "job": desc_of.get(si["Stage ID"]),
                "tasks": si["Number of Tasks"],
                "input_rows": acc.get("internal.metrics.input.recordsRead"),
                "shuffle_records": acc.get("internal.metrics.shuffle.write.recordsWritten"),
                "shuffle_bytes": acc.get("internal.metrics.shuffle.write.bytesWritten"),
                "run_ms": acc.get("internal.metrics.executorRunTime"),
            })
    return rows


def main() -> None:
    for r in stage_rows(sys.argv[1]):
        print(json.dumps(r))


if __name__ == "__main__":
    main()
