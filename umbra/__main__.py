"""Command line: sanitise files and trees of files.

python -m umbra FILES... [-o OUT] [-c POLICY] [-r] [--force] [--suffix S] [--map-out FILE] [--strict] [-R] [--print-config] [--list-rules] [--version]
Exit status: 0 done, 1 wrong use or a file that failed, 2 findings under --strict.
"""

from __future__ import annotations

import argparse
import os
import sys

from umbra.plans import rulebook as book
from umbra.plans.policy import Policy, PolicyError


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def _arguments() -> argparse.ArgumentParser:
    p = _Parser("umbra", description="Sanitise device configurations.")
    p.add_argument("files", nargs="*")
    p.add_argument("-o", "--out", help="folder (or file, for one input) to write to")
    p.add_argument("-c", "--config", help="policy in TOML")
    p.add_argument("-r", "--replace", action="store_true", help="write over the inputs")
    p.add_argument("--force", action="store_true", help="also take marked files and ones that are no UTF-8")
    p.add_argument("--suffix", default="", help="put before the extension of outputs")
    p.add_argument("--map-out", help="file for the mapping back to the originals")
    p.add_argument("--strict", action="store_true", help="exit with 2 if anything is found in the output")
    p.add_argument("-R", "--report", action="store_true", help="a summary on stderr")
    p.add_argument("--print-config", action="store_true")
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--version", action="version", version="umbra 1")
    return p


def _stdin(policy: Policy, salt: bytes, args: argparse.Namespace) -> int:
    from umbra.plans.document import sanitise_text

    o = sanitise_text(sys.stdin.read(), policy, salt)
    sys.stdout.write(o.text)
    for line, check, text in o.findings:
        print(f"-: L{line} [{check}] {text}", file=sys.stderr)
    return 2 if o.findings and args.strict else 0


def main(argv: list[str] | None = None) -> int:
    parser = _arguments()
    args = parser.parse_args(argv)
    try:
        policy = Policy.load(args.config)
    except (PolicyError, ValueError, OSError) as e:
        parser.error(str(e))
    if args.print_config:
        print(policy.to_toml(), end="")
        return 0
    if args.list_rules:
        for name, family in book.RULE_FAMILY.items():
            print(f"{name:28}{family:12}{policy.rule_action(name)}")
        return 0
    if not args.files:
        parser.error("no input")
    if args.replace and args.out:
        parser.error("--replace and --out exclude each other")
    from umbra.sources import tree

    salt = tree.load_salt(policy.sections[""]["salt_file"] or None)
    if args.files == ["-"]:
        return _stdin(policy, salt, args)
    if not (args.replace or args.out):
        parser.error("--out or --replace is needed")
    missing = [f for f in args.files if not os.path.exists(f)]
    if missing:
        parser.error(f"no such file: {', '.join(missing)}")
    return _files(parser, policy, salt, args)


def _files(parser: argparse.ArgumentParser, policy: Policy, salt: bytes, args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from umbra.operators import corpus, reports
    from umbra.sources import tree

    spark = SparkSession.builder.appName("umbra").getOrCreate()
    files = tree.read_tree(spark, [os.path.abspath(f) for f in args.files], args.force).cache()
    root = "file:" + (os.path.abspath(args.files[0]) if len(args.files) == 1 and os.path.isdir(args.files[0]) else os.path.commonpath([os.path.dirname(os.path.abspath(f)) or "/" for f in args.files]))
    out = args.out and "file:" + os.path.abspath(args.out)
    taken = files.where("reason is null").withColumn("dest", tree.destination(F.col("path"), root, out, args.suffix, args.replace))
    clash = tree.collisions(taken).limit(1).collect()
    if clash:
        parser.error(f"{clash[0].n} files would be written to {clash[0].dest}")
    folded = corpus.sanitise(taken, policy, salt).cache()
    placed = folded.where("error is null").withColumn("text", tree.marked_text(F.col("lines"), F.col("vendor"), F.col("crlf")))
    failed = tree.write_tree(placed).where("error is not null").union(folded.where("error is not null").select("dest", "error")).collect()
    found = False
    for f in reports.top_findings(corpus.findings(folded, "path"), "path").orderBy("path", "check", "rank").toLocalIterator():
        found = True  # lines count from the marker, the first of the written file
        print(f"{f.path}: L{f.line + 1} [{f.check}] {f.text}" + (f" ... {f.more} more" if f.rank == 5 and f.more else ""), file=sys.stderr)
    for f in failed:
        print(f"{f.dest}: {f.error}", file=sys.stderr)
    kept = folded.select(F.explode("clashes").alias("address")).distinct()
    clashing = kept.count()
    if clashing:
        sample = ", ".join(r.address for r in kept.orderBy("address").limit(5).collect())
        print(f"warning: {clashing} kept addresses lie inside a pseudonym pool: {sample}", file=sys.stderr)
    if args.report:
        print(f"policy: {policy.summary()}", file=sys.stderr)
        for r in reports.by_family(corpus.hits(folded, "path").where("action <> 'keep'")).orderBy(F.desc("hits")).collect():
            print(f"{r.hits:8} {r.family or 'all'} {r.rule or ''}", file=sys.stderr)
        for r in reports.skip_tally(files).collect():
            print(f"{r.n:8} skipped: {r.reason}", file=sys.stderr)
    if args.map_out:
        mapping: dict = {}
        for r in corpus.mapping(folded, "path").toLocalIterator():
            mapping.setdefault(r.path, {}).setdefault(r.kind, {})[r.original] = r.pseudonym
        tree.write_mapping(mapping, args.map_out)
    return 1 if failed else 2 if found and args.strict else 0


if __name__ == "__main__":
    sys.exit(main())
