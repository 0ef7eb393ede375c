"""Switches and limits of the pipeline, as one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    #: Which stages a run goes through.
    rewrite: bool = True
    unmask: bool = True
    reformat: bool = True
    #: Requests and seconds of a rate window.
    rate_limit: int = 20
    window_seconds: int = 60
    #: Least sizes of meaningful text.
    min_chars: int = 40
    min_words: int = 10
    #: Opt-in guards.
    detect_sql: bool = False
    detect_html: bool = False
    reject_symbol_only: bool = False
    check_language: bool = False
    #: Language guard.
    lang_min_chars: int = 80
    lang_min_confidence: float = 0.85
    lang_close: bool = False
    #: Input limit in tokens; 0: none.
    token_limit: int = 0
    #: Which writes run: ``db_disabled`` stops all, ``store`` allows guarded ones, ``mirror`` the nine-column copy.
    db_disabled: bool = False
    store: bool = True
    mirror: bool = False
    qa_sheet: bool = False
    #: Prompt templates by (check type, format).
    templates: dict = field(default_factory=dict)
