"""Plan-time switches: they become literals of the plan, so what is off costs nothing."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    normalize_values: bool = True
    fuzzy_flags: bool = True
    fuzzy_sponsor: bool = True
    fuzzy_labels: bool = True
    fee_fuzzy_recovery: bool = False
    biometric_upgrade: bool = True
    unpaid_waiver_upgrade: bool = False
    fallback_ocr_upgrade: bool = True
    finding_bypass: bool = True
    ocr_only_guard: bool = True
    defensive_downgrade: bool = False
    reread: bool = True
    sharpen_pass: bool = True
    sparse_text_pass: bool = True
    rotation_pass: bool = False
    deskew_pass: bool = False
    #: A list of words for the engine; no file, no list.
    user_words: str | None = None
    ocr_cache_dir: str | None = None

    @classmethod
    def from_env(cls, name: str = "DOCKETRY_OCR_CACHE_DIR") -> Config:
        """The cache folder from the environment; what the engine does is never read from there."""
        return cls(ocr_cache_dir=os.environ.get(name, "").strip() or None)


CONFIG = Config()
