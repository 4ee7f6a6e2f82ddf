"""Sinks: byte-deterministic archives and JSON projections, and workbook tabs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What every member of a normalised archive gets, and the member that comes first.
EPOCH, LEVEL, FIRST = (1980, 1, 1, 12, 0, 0), 6, "[Content_Types].xml"
# The tabs of a workbook in order, those of component categories first.
TABS = (
    "PV Modules",
    "Inverters-PCS",
    "Trackers & Mounting",
    "Transformers",
    "Cabling & Wiring",
    "Combiner Boxes",
    "BESS",
    "EMS-SCADA & Controls",
    "Executive Summary",
    "Conflicts & Open Items",
    "Sources & Provenance",
    "Compliance Matrix",
    "Tax Incentives",
)
# The tab of each component category.
CATEGORY_TABS = {
    "pv_modules": "PV Modules",
    "inverters_pcs": "Inverters-PCS",
    "trackers_mounting": "Trackers & Mounting",
    "transformers": "Transformers",
    "cabling_wiring": "Cabling & Wiring",
    "combiner_boxes": "Combiner Boxes",
    "bess": "BESS",
    "ems_scada": "EMS-SCADA & Controls",
}


def normalize_archive(path: str | Path) -> Path:
    """Rewrite a zip file so that equal contents give equal bytes; the file is replaced in one step."""
    path = Path(path)
    with zipfile.ZipFile(path) as z:
        members = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    if "docProps/app.xml" in members:
        members["docProps/app.xml"] = re.sub(rb"<(Application|AppVersion)>[^<]*</\1>", rb"<\1></\1>", members["docProps/app.xml"])
    if "docProps/core.xml" in members:
        members["docProps/core.xml"] = re.sub(rb"(<dcterms:(\w+)[^>]*>)[^<]*(</dcterms:\2>)", rb"\g<1>1980-01-01T12:00:00Z\g<3>", members["docProps/core.xml"])
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for member in sorted(members, key=lambda n: (n != FIRST, n)):
            info = zipfile.ZipInfo(member, EPOCH)
            info.compress_type, info.create_system, info.external_attr = zipfile.ZIP_DEFLATED, 3, 0o644 << 16
            z.writestr(info, members[member], compresslevel=LEVEL)
    os.replace(name, path)
    return path


def json_lines(df: DataFrame, order: list[str]) -> Iterator[str]:
    """Rows in order as canonical JSON (sorted keys, compact), one at a time; Python prints the numbers."""
    for r in df.orderBy(*order).toLocalIterator():
        yield json.dumps(r.asDict(recursive=True), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str)


def projection(components: DataFrame, conflicts: DataFrame, sources: DataFrame, orders: dict[str, list[str]], policy: dict) -> tuple[str, str]:
    """(canonical JSON of a release, its SHA-256); generated_on is the latest time among the rows, null without any."""
    parts = {"components": components, "conflicts": conflicts, "sources": sources}
    stamps = [df.agg(F.max(c)).first()[0] for df in parts.values() for c, t in df.dtypes if t == "timestamp"]
    body = {"projection_version": 1, "policy": policy, "generated_on": max((s for s in stamps if s), default=None)}
    body |= {k: [json.loads(x) for x in json_lines(df, orders[k])] for k, df in parts.items()}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str)
    return text, hashlib.sha256(text.encode()).hexdigest()


def fixture_bytes(x: object) -> bytes:
    """JSON as fixtures keep it: indented, sorted keys, a newline at the end."""
    return (json.dumps(x, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


def tab(fields: DataFrame, category: str, names: list[str]) -> DataFrame:
    """One tab: suppliers as rows, the given fields as columns, each the value's text; one row a component."""
    own = fields.where(F.col("component_category") == category)
    return own.groupBy("supplier", "model").pivot("field_name", names).agg(F.first("value_text", ignorenulls=True)).orderBy("supplier", "model")


def write_workbook(tabs: dict[str, DataFrame], dest: str | Path) -> Path:
    """A minimal workbook of ordered tabs with text cells, byte-deterministic; a driver-side report of bounded tables."""
    from xml.sax.saxutils import escape

    dest = Path(dest)
    names = list(tabs)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(dest, "w") as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr(FIRST, f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, df in enumerate(tabs.values(), 1):
            rows = [df.columns, *([("" if v is None else str(v)) for v in r] for r in df.toLocalIterator())]
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return normalize_archive(dest)
