"""

Usage: python tools/measure.py OUT_DIR [sf_dir ...]
Writes the Spark event log into OUT_DIR (a scratch folder) and prints one
JSON object per measurement. Each configuration: one cold run in the session,
then the median of 5 warm runs; shuffle/spill/job/stage counts of the last run
are read from the event log (jobs are tagged with a job group per run).
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def events(evdir):
    import zstandard
    for f in sorted(glob.glob(f"{evdir}/*/events*")):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def run_metrics(evdir, group):
    jobs, stages = set(), set()
    shuffle_w = spill_m = spill_d = tasks = 0
    for e in events(evdir):
        if e["Event"] == "SparkListenerJobStart" and \
                (e.get("Properties") or {}).get("spark.jobGroup.id") == group:
            jobs.add(e["Job ID"])
            stages.update(s["Stage ID"] for s in e["Stage Infos"])
        elif e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages:
            m = e.get("Task Metrics") or {}
            tasks += 1
            shuffle_w += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            spill_m += m.get("Memory Bytes Spilled", 0)
            spill_d += m.get("Disk Bytes Spilled", 0)
    return {"jobs": len(jobs), "stages_planned": len(stages), "tasks": tasks,
            "shuffle_write_bytes": shuffle_w, "spill_memory_bytes": spill_m,
            "spill_disk_bytes": spill_d}


def main():
    out = sys.argv[1]
    sfs = sys.argv[2:] or ["/root/testdata/sf0.01", "/root/testdata/sf0.1"]
    from cohortflow.operators.report import report
    from cohortflow.params import DRIVER_PARAMS as P
    from cohortflow.session import get_session
    from cohortflow.sources.staging import staged_catalog

    evdir = os.path.join(out, "eventlog")
    os.makedirs(evdir, exist_ok=True)
    spark = get_session("local[8]", 8, extra={"spark.eventLog.enabled": "true",
                                             "spark.eventLog.dir": evdir})
    sc = spark.sparkContext
    configs = []
    for sf in sfs:
        configs.append((sf, "report_all", P))
    big = sfs[-1]
    for n in (1, 24):
        configs.append((big, f"months={n}", P.with_(n_months=n)))
    configs.append((big, "scopes=1 (Pharmacy)", P.with_(verticals=("Pharmacy",))))
    results = []
    for i, (sf, name, params) in enumerate(configs):
        sc.setJobGroup(f"stage{i}", "staging")  # keep staging jobs out of the measured runs
        staged_catalog(spark, sf)
        times = []
        for r in range(6):
            group = f"m{i}r{r}"
            sc.setJobGroup(group, name)
            t = time.perf_counter()
            report(staged_catalog(spark, sf), params).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        res = {"sf": os.path.basename(sf), "config": name, "cold_sec": round(times[0], 2),
               "warm_median_sec": round(statistics.median(times[1:]), 2), "last_group": group}
        results.append(res)
    sc.setJobGroup("done", "done")
    spark.stop()
    for res in results:
        res.update(run_metrics(evdir, res.pop("last_group")))
        print(json.dumps(res))


if __name__ == "__main__":
    main()
