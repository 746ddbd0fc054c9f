"""Command line: build one dataset and print the run summary as JSON.

    python -m loomset --kind notes --input /data/notes --output /data/out/notes.jsonl --format alpaca
    python -m loomset --kind message_log --input /data/chats --output /data/out/chat.jsonl --no-redaction

On a cluster, ship the package (``--py-files``) and submit
``loomset/__main__.py`` with the same arguments, or call
:func:`loomset.plans.dataset.build_dataset` from your own job. The session is
the submitted one with its own master and settings; none is set here.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loomset.functions import rules
from loomset.plans.dataset import SOURCE_KINDS, build_dataset, plan_dataset


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="loomset", description="Build a fine-tuning dataset with Spark.")
    parser.add_argument("--kind", required=True, choices=SOURCE_KINDS)
    parser.add_argument("--input", required=True, nargs="+", help="file(s) or folder(s) to read")
    parser.add_argument("--output", required=True, help="output folder (JSONL part files), replaced")
    parser.add_argument("--format", default="sharegpt", choices=rules.FORMATS)
    parser.add_argument("--chunk-words", type=int, default=rules.DEFAULT_CHUNK_WORDS)
    parser.add_argument("--no-guardrails", action="store_true", help="keep harmful items")
    parser.add_argument("--no-redaction", action="store_true", help="keep personal data")
    parser.add_argument("--compression", default="none", help="text codec of the output files, e.g. gzip or zstd")
    parser.add_argument("--mode", default="FAILFAST", choices=("FAILFAST", "PERMISSIVE"), help="chat trees that do not parse")
    parser.add_argument("--split-arrays", action="store_true", help="chat trees: many tasks for each export file")
    parser.add_argument("--json-lines", action="store_true", help="chat trees with one conversation, or array of them, per line")
    parser.add_argument("--skip-hidden", action="store_true", help="leave out notes whose names start with '_' or '.'")
    parser.add_argument("--read-hidden", action="store_true", help="read such notes too; executors list the folders")
    parser.add_argument("--split-notes", type=int, metavar="BYTES", help="many tasks for each note file, in pieces of this size")
    parser.add_argument("--tables", help="JSON file with rule tables of your own: harm, pii, replacements")
    parser.add_argument("--explain", action="store_true", help="print the physical plan of the write job and stop")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    source = args.input if len(args.input) > 1 else args.input[0]
    multi_line = "split" if args.split_arrays else not args.json_lines
    hidden = "read" if args.read_hidden else "skip" if args.skip_hidden else "error"
    if args.tables:
        with open(args.tables, encoding="utf-8") as f:
            tables = rules.RuleTables(**json.load(f))
    else:
        tables = rules.TABLES
    reading = {"mode": args.mode, "multi_line": multi_line, "hidden": hidden, "tables": tables, "split_bytes": args.split_notes}
    if args.explain:
        records, _, _ = plan_dataset(
            spark, args.kind, source, args.format, not args.no_redaction, not args.no_guardrails, args.chunk_words, **reading
        )
        records.explain("formatted")
        return {}
    summary = build_dataset(
        spark,
        args.kind,
        source,
        args.output,
        dataset_format=args.format,
        sanitize_pii=not args.no_redaction,
        enforce_guardrails=not args.no_guardrails,
        chunk_words=args.chunk_words,
        compression=args.compression,
        **reading,
    )
    if summary["samples"] == 0:
        summary["warning"] = "no samples were produced"
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
