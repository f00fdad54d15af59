"""Command line: scan trees, list and explain rules, write reports and baselines.

Not provided: running cargo, updating the program itself, editing PATH.
"""

from __future__ import annotations

import argparse
import os
import sys
import threading
import time
import uuid
from dataclasses import replace
from pathlib import Path

from codequarry.operators.rule_table import all_rules, enabled_rules, explain_rule, rule_index
from codequarry.operators.settings import Settings
from codequarry.sources.config import ConfigError, config_template, read_config
from codequarry.sources.files import expand_targets, manifest_of, read_text


VERSION = "2"
#: read from the working folder where no --config is given
DEFAULT_CONFIG = "codequarry.toml"
#: skipped files that are named
MOST_WARNINGS = 100
#: seconds between two lines of progress
PROGRESS_SECONDS = 5.0


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codequarry", description="Rules over source trees, as Spark queries.")
    p.add_argument("paths", nargs="*", help="folders, single files or manifests; a manifest stands for its folder and the members of its workspace")
    p.add_argument("-V", "--version", action="version", version=f"codequarry {VERSION}")
    p.add_argument("--config", help=f"configuration file (default: {DEFAULT_CONFIG} in the working folder, if it is there)")
    p.add_argument("--rules", action="append", default=[], help="rule ids, comma-separated")
    p.add_argument("--categories", action="append", default=[], help="categories, comma-separated")
    p.add_argument("--max", action="store_true", dest="maximum", help="every rule, no prefilter")
    p.add_argument("--no-prefilter", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--sarif", action="store_true")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--baseline", help="baseline folder or file: its findings are left out")
    p.add_argument("--init-baseline", help="write the findings as a baseline to a new folder")
    p.add_argument("--cache", help="folder of the incremental cache")
    p.add_argument("--output", help="write the report, one row a line, to a new folder: distributed, for reports of any size")
    p.add_argument("--document", help="write the report as one file, made in the store by the executors: for reports of any size")
    p.add_argument("--benchmark", nargs="?", type=_iterations, const=5, metavar="N", help="scan N times (5) and report the times")
    p.add_argument("--quiet", action="store_true", help="no progress")
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--explain", metavar="ID")
    p.add_argument("--init-config", action="store_true", help="print a configuration template")
    return p


def _iterations(value: str) -> int:
    if not value.isdigit() or not int(value):
        raise argparse.ArgumentTypeError("a positive number is expected")
    return int(value)


def _listed(values: list[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x.strip() for v in values for x in v.split(",") if x.strip()))


def main(argv: list[str] | None = None) -> int:
    """0: nothing found; 1: findings; 2: the command line or configuration is wrong."""
    parser = _parser()
    try:
        args = parser.parse_args(argv)
    except SystemExit as stop:
        return 2 if stop.code else 0
    out, err = sys.stdout.write, sys.stderr.write
    settings = Settings()
    config = args.config or (DEFAULT_CONFIG if Path(DEFAULT_CONFIG).is_file() else None)
    try:
        if config:
            settings = read_config(Path(config).read_text(), settings)
    except (OSError, ConfigError) as error:
        err(f"invalid config {config}: {error}\n")
        return 2
    settings = replace(settings, only_rules=_listed(args.rules), only_categories=_listed(args.categories), maximum=args.maximum, prefilter=not (args.no_prefilter or args.maximum))
    if args.json and args.sarif:
        err("--json and --sarif exclude each other\n")
        return 2
    if args.init_config:
        ignored = Path(".gitignore")
        out(config_template(ignored.read_text() if ignored.is_file() else ""))
        return 0
    if args.explain:
        text = explain_rule(all_rules(settings), args.explain)
        (out if text else err)(text or f"unknown rule {args.explain}\n")
        return 0 if text else 2
    if args.list_rules:
        out(rule_index(all_rules(settings)))
        return 0
    if not args.paths:
        parser.print_help()
        return 0
    rules = enabled_rules(settings)
    if not rules:
        err("warning: no rule is enabled\n")
        return 0
    return _scan(args, settings, len(rules), out)


def _targets(spark, paths: list[str]) -> list[str]:
    """The given paths, with the folders of manifests and the members of their workspaces, each once. Manifests are read from the store that the path names."""
    # the JVM may have been started in another folder
    paths = [os.path.abspath(p) if "://" not in p and Path(p).exists() else p for p in paths]
    manifests = {m: text for m in map(manifest_of, paths) if (text := read_text(spark, m)) is not None}
    hadoop = spark._jvm.org.apache.hadoop.fs

    def there(path: str) -> bool:
        at = hadoop.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    return [p for p in expand_targets(paths, manifests) if p in paths or there(p)]


class Progress:
    """A with block's progress, told while its jobs run: from the tasks that Spark has done of those it knows of, the files that they stand for and the rate."""

    def __init__(self, context, n_files: int, tell, seconds: float | None = None):
        self.context, self.n_files, self.tell = context, n_files, tell
        self.seconds, self.ended = PROGRESS_SECONDS if seconds is None else seconds, threading.Event()
        self.group = f"codequarry-{uuid.uuid4().hex}"

    def line(self, took: float) -> str | None:
        tracker = self.context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(self.group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())}
        known = [i for i in map(tracker.getStageInfo, stages) if i]
        total, done = sum(i.numTasks for i in known), sum(i.numCompletedTasks for i in known)
        if not total:
            return None
        files = self.n_files * done // total
        return f"info: {done} of {total} tasks done, about {files} of {self.n_files} files in {took:.1f}s ({files / max(took, 0.001):.1f} files/s)\n"

    def _run(self, began: float) -> None:
        while not self.ended.wait(self.seconds):
            text = self.line(time.perf_counter() - began)
            if text:
                self.tell(text)

    def __enter__(self):
        self.context.setJobGroup(self.group, "scan")
        self.thread = threading.Thread(target=self._run, args=(time.perf_counter(),), daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *error) -> None:
        self.ended.set()
        self.thread.join()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.context.setLocalProperty(key, None)


def _scan(args: argparse.Namespace, settings: Settings, n_rules: int, out) -> int:
    from pyspark.sql import SparkSession

    from codequarry.sources.files import read_checked

    spark = SparkSession.builder.appName("codequarry").getOrCreate()
    began, files, skipped = time.perf_counter(), None, None
    for path in _targets(spark, args.paths):
        tree, lost = read_checked(spark, path, settings.exclude, settings.include)
        files, skipped = (tree, lost) if files is None else (files.unionByName(tree), skipped.unionByName(lost))
    files = files.dropDuplicates(["path"]).persist()
    lost = skipped.distinct().orderBy("path").persist()
    n_lost = lost.count()
    for row in lost.limit(MOST_WARNINGS).collect():
        sys.stderr.write(f"warning: skipped {row['path']}: {row['reason']}\n")
    if n_lost > MOST_WARNINGS:
        sys.stderr.write(f"warning: and {n_lost - MOST_WARNINGS} more\n")
    lost.unpersist()
    # files that are skipped count as scanned
    n_files = files.count() + n_lost
    tell = (lambda text: None) if args.quiet or args.json or args.sarif else sys.stderr.write
    tell(f"info: discovered {n_files} files in {time.perf_counter() - began:.2f}s\n")
    try:
        if args.benchmark:
            return _benchmark(args, settings, files, out)
        return _report(args, settings, files, n_files, n_rules, out, tell)
    finally:
        files.unpersist()


def _found(args: argparse.Namespace, settings: Settings, files):
    """A with block's findings of the files, from the cache where there is one."""
    from contextlib import nullcontext

    from codequarry.plans.cache import scan_with_cache
    from codequarry.plans.scan import scanning

    return nullcontext(scan_with_cache(files, args.cache, settings)) if args.cache else scanning(files, settings)


def _benchmark(args: argparse.Namespace, settings: Settings, files, out) -> int:
    """Times of repeated scans, every finding made and none kept: each run, then least, greatest, mean and upper median."""
    from codequarry.plans.stats import timing_stats

    spark, times = files.sparkSession, []
    for n in range(args.benchmark):
        began = time.perf_counter()
        with _found(args, settings, files) as found:
            found.write.format("noop").mode("overwrite").save()
        times.append(1000 * (time.perf_counter() - began))
        out(f"run {n + 1:>2}: {times[-1]:.2f}ms\n")
    row = timing_stats(spark.createDataFrame([("all", t) for t in times], "k string, v double"), "k", "v").first()
    out("\nsummary\n" + "".join(f"{name + ':':<7} {row[f'{name}_value']:.2f}ms\n" for name in ("min", "max", "mean", "median")))
    return 0


def _report(args: argparse.Namespace, settings: Settings, files, n_files: int, n_rules: int, out, tell) -> int:
    from codequarry.plans.scan import without_baseline
    from codequarry.sinks import report

    began = time.perf_counter()
    with _found(args, settings, files) as found:
        if args.init_baseline:
            report.write_baseline(found, args.init_baseline)
            return 0
        if args.baseline:
            found = without_baseline(found, report.read_baseline(files.sparkSession, args.baseline))
        found = found.persist()
        with Progress(files.sparkSession.sparkContext, n_files, tell):
            empty = not found.count()
        took = time.perf_counter() - began
        tell(f"info: scanned {n_files} files with {n_rules} rules in {took:.2f}s ({n_files / max(took, 0.001):.1f} files/s)\n")
        if args.document:
            form = "json" if args.json else "sarif" if args.sarif else "human"
            report.write_document(found, args.document, form, "codequarry", VERSION, args.pretty, n_files, n_rules)
        elif args.output:
            report.write_findings(found, args.output, "json" if args.json else "sarif" if args.sarif else "human")
        elif (args.json or args.sarif) and not args.pretty:
            for text in report.document_rows(found, "json" if args.json else "sarif", "codequarry", VERSION):
                out(text)
            out("\n")
        elif args.json or args.sarif:
            text = report.json_document(found) if args.json else report.sarif_document(found, "codequarry", VERSION)
            out(report.pretty_json(text))
        else:
            out(report.human_document(found, n_files, n_rules))
        found.unpersist()
    return 0 if empty else 1


if __name__ == "__main__":
    sys.exit(main())
