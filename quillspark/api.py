"""Public surface: one import for the corpus operators (all ``DataFrame -> DataFrame``)."""

from .operators.companies import (dedup_companies, resolve_tickers, search_companies,  # noqa: F401
                                  select_companies, unknown_tickers)
from .operators.documents import (clean_html, clean_ixbrl, clean_sgml, header_map, header_rows,  # noqa: F401
                                  html_to_text, metadata, route)
from .operators.facts import concept_series, ix_facts, read_concepts  # noqa: F401
from .operators.filings import (attach_text, classify_documents, company_filings, fetch_manifest,  # noqa: F401
                                filings_per_company, filter_forms, latest_filings, main_documents,
                                ordered_documents, reports_per_ticker, role_counts, run_summary)
from .operators.outline import mark_titles, outline, paragraphs  # noqa: F401
from .operators.render import render_documents  # noqa: F401
from .operators.sections import assemble_reports, clean_sections, section_stats, split_sections  # noqa: F401
from .plans.jobs import (assembled_reports, convert_to_html, corpus_build, extract_html,  # noqa: F401
                         main_slices, pdf_paragraphs, selection_summary)
from .plans.jobs import outcome_counts as outcomes  # noqa: F401
from .sinks import html_path, pdf_paths, report_names, text_sidecar, write_corpus, write_pages  # noqa: F401
from .sinks import write_page_files, write_report_files, write_sidecar_files, write_summary  # noqa: F401
from .sinks.files import write_files  # noqa: F401
from .sources.companies import company_items_from_json, company_items_from_payload, read_companies  # noqa: F401
from .sources.filings import filings_from_json, read_filings  # noqa: F401
from .sources.index_pages import read_index  # noqa: F401
from .sources.submissions import read_submissions, typed_documents  # noqa: F401
from .streaming.incremental import run_incremental  # noqa: F401
