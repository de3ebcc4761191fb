"""Secret scans with an incremental ledger of blobs.

Every version of every path is content-addressed by SHA-256. The ledger lists the (blob, rule version) pairs that were scanned and holds their findings. A run
scans only pairs that it does not list, each distinct blob once, and findings are joined back to all paths that ever held the blob.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import durable, fresh, lean, pieces, q, sifted

#: (rule, words of which a text must have one, pattern whose group ``s`` is the secret, least bits a character).
RULES: list[tuple[str, tuple[str, ...], str, float]] = [
    ("private_key", ("PRIVATE KEY",), r"(?P<s>-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]|-(?!----BEGIN ))*?-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s]*))", 0),
    ("cloud_access_key", ("AKIA", "ASIA"), r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA)[A-Z2-7]{16})(?![A-Za-z0-9])", 2.5),
    ("forge_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-"), r"(?<![A-Za-z0-9])(?P<s>gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,})", 2.5),
    ("chat_token", ("xox",), r"(?P<s>xox[abeoprs]-[A-Za-z0-9-]{10,})", 2.5),
    ("api_key", ("sk-", "sk_", "rk_", "pk_", "AIza"), r"(?<![A-Za-z0-9])(?P<s>sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})", 2.5),
    ("signed_web_token", ("eyJ",), r"(?<![A-Za-z0-9_-])(?P<s>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 2.5),
    ("url_password", ("://",), r"[a-z][a-z0-9+.-]{1,30}://[^\s/:@]+:(?P<s>[^\s/:@]{3,})@", 0),
    (
        "assigned_secret",
        ("token", "secret", "passw", "pwd", "key", "auth", "credential"),
        r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|credentials?|(?:api|access|auth|private|secret|encryption)[_-]?key)[\"']?[ \t]{0,5}(?:=>|:=|=|:)[ \t]{0,5}[\"']?(?P<s>[A-Za-z0-9_/+.=~-]{16,})",
        3.0,
    ),
]
#: Raise it when RULES change: pairs of another version count as not scanned.
RULE_VERSION = "1.2"
REDACTED = "[SECRET]"

_FINDINGS = "array<struct<rule:string,start:int,end:int,digest:string>>"


def _entropy(s: str) -> float:
    n = np.unique(list(s), return_counts=True)[1] / len(s)
    return float(-(n * np.log2(n)).sum())


class Scanner:
    """Compiled rules. A rule runs only over texts that hold one of its words."""

    def __init__(self, rules: list[tuple[str, tuple[str, ...], str, float]]):
        self.rules = [(name, tuple(w.lower() for w in words), re.compile(p), bits) for name, words, p, bits in rules]

    def scan(self, text: str) -> list[tuple[str, int, int, str]]:
        """(rule, start, end, SHA-256 of the secret), in order; of findings that overlap, the first rule's stands."""
        low = text.lower()
        out: list[tuple[int, int, str, str]] = []  # in order of their places, none overlaps another
        for name, words, pattern, bits in self.rules:
            if words and not any(w in low for w in words):
                continue
            for m in pattern.finditer(text):
                s, e = m.span("s")
                at = bisect.bisect(out, (s,))
                free = (at == 0 or out[at - 1][1] <= s) and (at == len(out) or e <= out[at][0])
                if free and (bits == 0 or _entropy(m["s"]) >= bits):
                    out.insert(at, (s, e, name, hashlib.sha256(m["s"].encode()).hexdigest()))
        return [(name, s, e, digest) for s, e, name, digest in out]


def redact(text: str, findings: list[tuple[str, int, int, str]], by: str = REDACTED) -> str:
    parts, at = [], 0
    for _, s, e, _ in findings:
        parts += [text[at:s], by]
        at = e
    return "".join([*parts, text[at:]])


def blob_id(text_col: str):
    """The content address of a text: SHA-256 of its UTF-8 bytes."""
    return F.sha2(q(text_col).cast("binary"), 256)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: list = RULES, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """(blob, rule_version, findings) of the pairs of ``versions`` that ``ledger`` does not list; blobs without findings are listed too.

    Write it beside the ledger, and the next run scans only what is new. Null texts are no blobs; the empty text is one. Rows alike, and all copies of a text, are one blob; texts are
    scanned whole, however long. Findings of one text never overlap: the first rule's stands. An empty table gives an empty result; other columns are not read.
    """
    scanner = Scanner(rules)
    blobs = versions.select(blob_id(text_col).alias("blob"), q(text_col).alias("text")).where("text is not null")
    # blobs come together by hash, once; a very common one may be split over tasks and scanned once in each
    if ledger is not None:
        listed = ledger.where(F.col("rule_version") == rule_version).select("blob").hint("merge")
        blobs = blobs.join(listed, "blob", "left_anti")
    else:
        blobs = blobs.hint("rebalance", F.col("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            ids, found = [], []
            for ident, text in zip(b.column("blob").to_pylist(), b.column("text"), strict=True):
                if ident not in seen:
                    seen.add(ident)
                    ids.append(ident)
                    found.append([dict(zip(("rule", "start", "end", "digest"), x, strict=True)) for x in scanner.scan(text.as_py())])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, kind)], ["blob", "findings"])

    out = blobs.mapInArrow(lean(run), f"blob string, findings {_FINDINGS}").dropDuplicates(["blob"])
    return out.select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def findings_by_path(versions: DataFrame, ledger: DataFrame, path_cols: list[str], rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """(path columns, blob, rule, start, end, digest) of every path that ever held a blob with findings.

    A column whose name a path column has gets an underscore behind it. ``start`` and ``end`` count characters; the secret itself is never given, only its SHA-256. Rows alike in
    path and text count once; null texts have no blob, null paths are paths like others. An empty table or ledger gives an empty result.
    """
    blob = fresh(versions, "loom_blob")
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select(F.col("blob").alias(blob), F.explode("findings").alias("f"))
    taken = {c.lower() for c in path_cols}
    name = lambda c: f"{c}_" if c in taken else c
    paths = versions.where(q(text_col).isNotNull()).select(*[q(c) for c in path_cols], blob_id(text_col).alias(blob)).distinct()
    found = [F.col("f")[c].alias(name(c)) for c in ("rule", "start", "end", "digest")]
    return paths.join(hits, blob).select(*[q(c) for c in path_cols], F.col(blob).alias(name("blob")), *found)


def redact_secrets(docs: DataFrame, ledger: DataFrame, by: str = REDACTED, rule_version: str = RULE_VERSION, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All documents, with each secret that the ledger lists for their text replaced by ``by``, and ``size_col``, where there is one, set anew for texts that change.

    Scan the documents into the ledger first (``scan_new``). Only blobs with findings are joined, and only their texts, and about one in 200 of the others, move or pass through Python. Null and empty texts stay;
    all other columns stay as they are; repeated rows are treated alike; texts of any length are cut whole. An empty table stays empty, an empty ledger changes nothing.
    """
    key, found = fresh(docs, "loom_blob"), fresh(docs, "loom_findings")
    names = [*docs.columns]
    at = [c.lower() for c in names].index(text_col.lower())
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select(F.col("blob").alias("loom__b"), F.col("findings").alias(found)).dropDuplicates(["loom__b"])
    # stored, so that its size is known before the join is planned
    hits = durable(hits)
    rest, maybe = sifted(docs.withColumn(key, blob_id(text_col)), F.xxhash64(q(key)), hits.select(F.xxhash64("loom__b")))
    marked = maybe.join(hits, q(key) == F.col("loom__b"), "left").select(*[q(c) for c in names], q(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            cols = list(b.columns)[: len(names)]
            hit = b.column(len(names))
            change: dict[int, str] = {}
            for i in np.flatnonzero(np.asarray(hit.is_valid())).tolist():
                change[i] = redact(cols[at][i].as_py(), [(x["rule"], x["start"], x["end"], x["digest"]) for x in hit[i].as_py()], by)
            if change:
                texts = cols[at].to_pylist()
                for i, t in change.items():
                    texts[i] = t
                cols[at] = pa.array(texts, cols[at].type)
                for j, c in enumerate(names):
                    if c.lower() == size_col.lower() and pa.types.is_integer(cols[j].type):
                        sizes = cols[j].to_pylist()
                        for i, t in change.items():
                            sizes[i] = len(t)
                        cols[j] = pa.array(sizes, cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([b.schema.field(j) for j in range(len(names))]))

    return rest.select(*[q(c) for c in names]).union(marked.mapInArrow(lean(run), docs.schema))
