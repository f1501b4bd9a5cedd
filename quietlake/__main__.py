"""Commands: check, run, scrub, scan, schema, refresh, verify."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import profile
from .operators.audit import AuditLog
from .operators.broker import ALLOWED, DENIED, Broker, Denied, OverCeiling, QueryFailed
from .operators.suppress import Refused
from .plans.policy import Policy, Settings
from .sources import blobs, catalog, git, mail, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quietlake", description=__doc__)
    p.add_argument("--policy", help="policy file; else the default policy")
    p.add_argument("--tables", help="a folder of table.parquet files to make visible")
    p.add_argument("--home", default=".quietlake", help="folder of index, log and results")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "run"):
        sub.add_parser(name).add_argument("file")
    s = sub.add_parser("scrub")
    s.add_argument("file")
    s.add_argument("--check", action="store_true", help="exit 1 on any finding; write nothing")
    s.add_argument("--in-place", action="store_true")
    s = sub.add_parser("scan")
    s.add_argument("path", help="a folder; with --git a repository")
    s.add_argument("--git", help="scan blobs of the repository: staged, all, or a range of commits")
    s.add_argument("--strict", action="store_true", help="what can't be read blocks, whatever is allowed")
    s.add_argument("--ignore", action="append", default=[])
    s.add_argument("--allow-unscannable", action="store_true")
    sub.add_parser("schema").add_argument("pattern")
    s = sub.add_parser("refresh")
    s.add_argument("--stats", action="store_true")
    s.add_argument("--draft-policy", action="store_true")
    s.add_argument("--manifests", help="a folder in and below which build tools' manifests are looked for")
    s.add_argument("--catalogs", nargs="*", help="catalogs whose relations are indexed; one that can't be read is skipped")
    sub.add_parser("verify")
    return p


def scrub_file(path: Path, check: bool, in_place: bool) -> int:
    """Messages as a copy ``.scrubbed.eml``, other texts to stdout or in place."""
    if path.suffix == ".eml":
        out, report = mail.scrub(path.read_bytes())
        if check:
            return int(not report.clean)
        (path if in_place else path.with_suffix(".scrubbed.eml")).write_bytes(out)
        return 0
    report = mail.MailReport()
    text = mail.redact_lines(path.read_text(errors="replace"), report)
    if check:
        return int(bool(report.identifiers))
    if in_place:
        path.write_text(text)
    else:
        sys.stdout.write(text)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "scrub":
        return scrub_file(Path(a.file), a.check, a.in_place)
    spark = spark or SparkSession.builder.appName("quietlake").getOrCreate()
    home = Path(a.home)
    home.mkdir(parents=True, exist_ok=True)
    policy = Policy.load(a.policy) if a.policy else Policy.default()
    log, index_path = AuditLog(home / "audit.jsonl"), home / "index.json"
    names = []
    if a.tables:
        names = sorted(p.stem for p in Path(a.tables).glob("*.parquet"))
        catalog.files(spark, a.tables, tuple(names))
    if a.command == "verify":
        ok, line = log.verify(spark)
        print("the log holds" if ok else f"the log breaks at line {line}")
        return int(not ok)
    if a.command == "scan":
        most = Settings.of(spark).max_blob_bytes
        texts = (git.read_git(spark, a.path, a.git, tuple(a.ignore), most) if a.git else blobs.read_files(spark, a.path, tuple(a.ignore), most)).cache()
        hits = blobs.scan_lines(texts)
        for r in hits.orderBy("path", "line_no").toLocalIterator():
            print(f"{r['path']}:{r['line_no']}: {', '.join(r['kinds'])}")
        s = blobs.scan_summary(texts, hits).first()
        texts.unpersist()
        print(f"{s['files']} files, {s['files_with_hits']} with hits, {s['unscannable']} unscannable")
        return int(blobs.blocked(s["files_with_hits"], s["unscannable"], a.allow_unscannable, a.strict))
    if a.command == "refresh":
        settings, relations = Settings.of(spark), names or None
        if a.catalogs:
            relations, skipped = profile.relations_of(spark, a.catalogs)
            for c, why in skipped.items():
                print(f"{c} skipped: {why}", file=sys.stderr)
        written, broken = profile.from_manifests(profile.discover(a.manifests)) if a.manifests else ({}, [])
        for p in broken:
            print(f"{p} can't be read", file=sys.stderr)
        live = profile.snapshot(spark, relations, a.stats, settings.profile_columns)
        index = profile.merged({**profile.load(index_path), **written}, live)
        profile.save(index, index_path)
        if a.draft_policy:
            for r in profile.draft(spark.createDataFrame([(n,) for n in index], "relation string"), policy).orderBy("level").collect():
                print(f"{r['level']}: {', '.join(r['names'])}")
        log.append("refresh", relations=len(index), stats=a.stats)
        return 0
    if a.command == "schema":
        index = profile.load(index_path)
        found = profile.search(spark.createDataFrame([(n,) for n in index], "relation string"), a.pattern) if index else None
        for r in found.orderBy("relation").collect() if found is not None else []:
            print(profile.render(index, r["relation"]))
        return 0
    broker = Broker(spark, policy, index=profile.load(index_path), audit=log, out=home / "out")
    sql = Path(a.file).read_text()
    if a.command == "check":
        v = broker.check(sql)
        log.append("check", verdict="ALLOW" if v.allowed else "DENY", sql=sql)
        print("ALLOW" if v.allowed else "DENY\n" + "\n".join(v.reasons))
        return ALLOWED if v.allowed else DENIED
    try:
        print(sinks.echo(broker.run(sql).df))
        return ALLOWED
    except (Denied, OverCeiling, QueryFailed, Refused) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return {Denied: 1, QueryFailed: 3, Refused: 4, OverCeiling: 5}[type(e)]


if __name__ == "__main__":
    sys.exit(main())
