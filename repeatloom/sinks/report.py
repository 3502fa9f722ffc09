"""A self-contained review page: findings, a worklist, and each locus's reads."""

from __future__ import annotations

import html
import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import qc
from ..schema import PER_READ_COLUMNS

_ORDER = {"finding": 0, "check": 1, "uninformative": 2, "normal": 3}
_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ccc;text-align:left}.finding{background:#fdd}.check{background:#ffd}.uninformative{color:#777}pre{white-space:pre-wrap;word-break:break-all}"
_SCRIPT = "const D=JSON.parse(document.getElementById('data').textContent);document.querySelectorAll('tr[data-locus]').forEach(r=>r.onclick=()=>{const d=D[r.dataset.locus]||[];document.getElementById('reads').textContent=r.dataset.locus+'\\n'+d.map(x=>[x.read_id,x.read_class,x.allele,x.n_total_units,x.structure_string].join('\\t')).join('\\n')})"


def payload(reads: DataFrame) -> DataFrame:
    """(locus, reads): each locus's reads nested as JSON, by falling size, then by name.

    A read's size is its units, of a partial read its lower bound; none comes last.
    """
    number = lambda c: F.try_to_number(c, F.lit("999999")).cast("int")
    units = F.coalesce(number("n_total_units"), number("lower_bound_units"), F.lit(-1))
    rows = F.collect_list(F.struct((-units).alias("key"), "read_id", F.struct(*PER_READ_COLUMNS).alias("read")))
    nested = F.transform(F.sort_array(rows), lambda x: x["read"])
    return reads.groupBy("locus").agg(F.to_json(nested).alias("reads"))


def report_date() -> str:
    """Today's date, or that of SOURCE_DATE_EPOCH."""
    at = os.environ.get("SOURCE_DATE_EPOCH")
    return time.strftime("%Y-%m-%d", time.gmtime(int(at) if at and at.isdigit() else time.time()))


def build(loci: DataFrame, reads: DataFrame, sample: str, catalogue: str | None = None) -> str:
    """The page as text. loci and reads: the text tables; a catalogue's loci are few."""
    rows = sorted((r.asDict() for r in loci.withColumn("tier", qc.tier()).collect()), key=lambda r: (_ORDER[r["tier"]], r["ord"]))
    findings = [r.asDict() for r in qc.run_checks(loci).orderBy("no").collect()]
    nested = {r["locus"]: json.loads(r["reads"]) for r in payload(reads).collect()}
    esc = lambda x: html.escape(str(x), quote=True)
    shown = ["locus", "gene", "tier", "a1_median", "a2_median", "a1_cls", "a2_cls", "evidence", "method", "notes"]
    body = [f"<h1>{esc(sample)}</h1><p>{report_date()}{" - catalogue " + esc(catalogue) if catalogue else ""}</p><h2>Checks</h2><ul>"]
    body += [f"<li>{esc(f['status'])}: {esc(f['check'])} - {esc(f['message'])}</li>" for f in findings]
    body += ["</ul><h2>Loci</h2><table><tr>", *[f"<th>{c}</th>" for c in shown], "</tr>"]
    for r in rows:
        body += [f'<tr class="{r["tier"]}" data-locus="{esc(r["locus"])}">', *[f"<td>{esc(r[c])}</td>" for c in shown], "</tr>"]
    data = json.dumps(nested).replace("</", "<\\/")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{esc(sample)}</title><style>{_STYLE}</style></head><body>{"".join(body)}</table><h2>Reads</h2><pre id="reads"></pre><script type="application/json" id="data">{data}</script><script>{_SCRIPT}</script></body></html>'
