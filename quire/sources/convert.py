"""Converters for formats that are not parsed here: commands of a local office suite or e-book tool, off unless asked for."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: seconds that a conversion may take.
TIMEOUT = 120
OFFICE, EBOOK = ("soffice", "libreoffice"), ("ebook-convert",)


def find(names: tuple[str, ...], extra: tuple[str, ...] = ()) -> str | None:
    """The first command on the path, else the first of the extra places that exists."""
    return next((p for p in map(shutil.which, names) if p), None) or next((p for p in extra if Path(p).exists()), None)


def to_docx(data: bytes, suffix: str, tool: str | None = None) -> bytes:
    """The file as DOCX. PDFs go through the e-book tool, all others through the office suite; FileNotFoundError without it."""
    pdf = suffix == ".pdf"
    tool = tool or find(EBOOK if pdf else OFFICE)
    if tool is None:
        raise FileNotFoundError(f"no converter for {suffix}")
    with tempfile.TemporaryDirectory() as folder:
        source, target = Path(folder, f"entrada{suffix}"), Path(folder, "entrada.docx")
        source.write_bytes(data)
        if pdf:
            command = [tool, str(source), str(target)]
        else:
            command = [tool, "--headless", *(["--infilter=HTML (StarWriter)"] if suffix in (".html", ".htm") else []), "--convert-to", "docx", "--outdir", folder, str(source)]
        subprocess.run(command, check=True, capture_output=True, timeout=TIMEOUT)
        made = target if target.exists() else next(iter(sorted(Path(folder).glob("*.docx"))), None)
        if made is None:
            raise RuntimeError("the converter wrote nothing")
        return made.read_bytes()


def converted(files: DataFrame, tools: dict[str, str] | None = None) -> DataFrame:
    """(path, content, error): files (path, content) as DOCX, each by a command on its executor; a DOCX stays, a failure leaves its reason.

    tools may name the commands, by ".pdf" and "" for all others. The folder that a command works in is scratch space of its task.
    """
    named = tools or {}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                suffix = "." + row.path.rsplit(".", 1)[-1].lower()
                try:
                    rows.append((row.path, bytes(row.content) if suffix == ".docx" else to_docx(bytes(row.content), suffix, named.get(".pdf" if suffix == ".pdf" else "")), None))
                except (OSError, RuntimeError, subprocess.SubprocessError) as e:
                    rows.append((row.path, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")
