"""Plain Python versions of what the queries must return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import xxhash


def table(sf_dir: str, name: str) -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def rows_of(df) -> Counter:
    return Counter(tuple(sorted(r.asDict().items(), key=lambda kv: kv[0])) for r in df.collect())


def counted(rows) -> Counter:
    return Counter(tuple(sorted(r.items())) for r in rows)


def lower_az(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: list[int], linked) -> dict[int, int]:
    """Value to the least value of its component; all pairs are compared."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in ordered}


def near_groups(docs: list[dict]) -> list[dict]:
    prints = [simhash(d["text"]) for d in docs]
    of = components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    least: dict[int, int | None] = {}
    for d, p in zip(docs, prints):
        ids = [i for i in (d["doc_id"], least.get(of[p])) if i is not None]
        least[of[p]] = min(ids) if ids else None
    return [{"doc_id": d["doc_id"], "fingerprint": f"{p:016x}", "component_id": least[of[p]]} for d, p in zip(docs, prints)]


def token_rows(docs: list[dict], path: str) -> list[dict]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, start = [], 0

    def order(d):
        h = 42 if d["text"] is None else xxhash.xxh64_intdigest(d["text"].encode(), seed=42)
        return (d["doc_id"] is not None, d["doc_id"] or 0, h - (1 << 64) if h >> 63 else h)

    for d in sorted(docs, key=order):
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        out.append({"doc_id": d["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": crc})
        start += len(ids)
    return out


def contamination(docs: list[dict], items: list[dict]) -> list[dict]:
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))

    windows: dict[tuple, set] = {}
    for item in items:
        w = words(item["text"])
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item["item_id"]))
    out = []
    for d in docs:
        w = words(d["text"])
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                ids = windows.get(tuple(w[i : i + m]))
                if ids:
                    hit |= set(range(i, i + m))
                    found |= ids
        out.append(
            {
                "doc_id": d["doc_id"],
                "n_words": len(w),
                "n_hit": len(hit),
                "n_items": len(found),
                "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                "contaminated": bool(hit) and 20 * len(hit) >= len(w),
            }
        )
    return out


def repeats(docs: list[dict], size: int = 100) -> list[dict]:
    """Rows with distinct ids; every window of ``size`` bytes is looked up."""
    seen: set[bytes] = set()
    out = []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        raw = (d["text"] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            window = raw[i : i + size]
            if window in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append(
            {
                "doc_id": d["doc_id"],
                "n_bytes": len(raw),
                "n_removed": sum(gone),
                "n_spans": len(re.findall(b"\1+", bytes(gone))),
                "kept_sha256": hashlib.sha256(kept).hexdigest(),
            }
        )
    return out


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    found = [(k, m.start(), m.end()) for k, p, g, n in BASE for m in p.finditer(text or "") if len(m[g]) >= n]
    return sorted(found, key=lambda s: (s[1], [b[0] for b in BASE].index(s[0])))
