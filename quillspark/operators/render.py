"""One rendering operator with four page templates (text, sgml, ixbrl, extract).

Pages are minimal HTML of our own; bodies are inserted unescaped, as the
reference does.  ``generated_at`` is a parameter (no clock inside a job).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTICE = ("<div class=\"notice\"><strong>Notice:</strong> this filing appears to hold only exhibits, "
          "signatures and regulatory content; its main narrative sections are not in this file.</div>")


def _page(title: Column, header: list[Column], body: Column) -> Column:
    parts = [F.lit("<!DOCTYPE html>\n<html>\n<head>\n<meta charset=\"UTF-8\">\n<title>"), title,
             F.lit("</title>\n</head>\n<body>\n<div class=\"header\">\n")]
    for h in header:
        parts += [F.lit("<div>"), h, F.lit("</div>\n")]
    parts += [F.lit("</div>\n"), body, F.lit("\n</body>\n</html>\n")]
    return F.concat(*parts)


def text_page(file_name: Column, content: Column, generated_at: str) -> Column:
    """T19a."""
    return _page(file_name, [F.lit("Filing document"), file_name, F.lit(f"Generated on {generated_at}")],
                 F.concat(F.lit("<div class=\"content\">"), content, F.lit("</div>")))


def filing_page(meta: dict[str, Column], body: Column, generated_at: str,
                notice: Column | None = None, source: Column | None = None) -> Column:
    """T19b / T19c / T19d: company, type, accession, date, generation time (+ source file).

    The metadata is bound once: the company and type appear in both title and header.
    """
    from ..functions.text import let

    def page(m):
        header = [m["company"], m["document_type"],
                  F.concat(F.lit("Accession Number: "), m["accession"]),
                  F.concat(F.lit("Filing Date: "), m["filing_date"]),
                  F.lit(f"Generated: {generated_at}")]
        if source is not None:
            header.append(F.concat(F.lit("Source: "), source))
        content = F.concat(F.lit("<div class=\"content\">"), body, F.lit("</div>"))
        if notice is not None:
            content = F.concat(F.when(notice, F.lit(NOTICE + "\n")).otherwise(F.lit("")), content)
        title = F.concat(m["company"], F.lit(" - "), m["document_type"]) if source is not None \
            else m["company"]
        return _page(title, header, content)

    return let(F.struct(*[v.alias(k) for k, v in meta.items()]), page)


def render_documents(df, template: str, generated_at: str, content: str = "content",
                     file_name: str = "file_name", body: str | None = None, out: str = "html"):
    """T19 as a DataFrame operator: one of the four page templates over a table.

    * ``text``    -- page around the raw content (T19a)
    * ``sgml``    -- header-map metadata + cleaned SGML body (T19b)
    * ``ixbrl``   -- regex metadata, assembled report, truncated notice, titles marked (T19c)
    * ``extract`` -- regex metadata + the given ``body`` column + source file (T19d)
    """
    from ..functions import text as T
    from . import documents as D
    from . import sections as S
    c, f = F.col(content), F.col(file_name)
    if template == "text":
        page = text_page(f, c, generated_at)
    elif template == "sgml":
        page = T.let(D.header_map(c), lambda h: filing_page(D.sgml_metadata(h), D.sgml_body(c), generated_at))
    elif template == "ixbrl":
        page = T.let(S.report_struct(c), lambda rs: filing_page(
            D.regex_metadata(c, f), T.mark_titles(T.clean_ixbrl_text(rs["report"])), generated_at,
            notice=rs["truncated"]))
    elif template == "extract":
        if body is None:
            raise ValueError("the extract template needs a body column")
        page = filing_page(D.regex_metadata(c), F.col(body), generated_at, source=f)
    else:
        raise ValueError(f"unknown template {template}")
    return df.withColumn(out, page)
