"""Single-threaded plain-Python statement of the same work, as a single-node yardstick.

Runs ``pyref`` (the test-only Python statement of the rules) over the whole
sf tables: notes = classify + redact + chunk every document; logs = every
conversation as one log of ``[stamp] role: text`` lines -> six-message windows.

    python tests/python_baseline.py /root/testdata/sf0.1
"""

from __future__ import annotations

import json
import os
import sys
import time

import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pyref  # noqa: E402


def main(sf_dir: str) -> dict:
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()
    t = time.perf_counter()
    chunks = sum(len(c) for c in (pyref.note_chunks(d) for d in docs) if c)
    notes_sec = time.perf_counter() - t

    conv = pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()
    logs: dict[int, list[str]] = {}
    for row in sorted(conv, key=lambda r: (r["conv_id"], r["turn"])):
        text = " ".join(row["text"].splitlines())
        logs.setdefault(row["conv_id"], []).append(f"[1/2/24, 10:00:00 AM] {row['role']}: {text}")
    t = time.perf_counter()
    windows = sum(len(pyref.log_windows(lines)) for lines in logs.values())
    logs_sec = time.perf_counter() - t
    return {
        "documents": len(docs),
        "chunks": chunks,
        "notes_sec": round(notes_sec, 3),
        "documents_per_sec": round(len(docs) / notes_sec, 1),
        "messages": len(conv),
        "windows": windows,
        "logs_sec": round(logs_sec, 3),
        "messages_per_sec": round(len(conv) / logs_sec, 1),
    }


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")))
