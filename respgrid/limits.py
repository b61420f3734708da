"""Caps against hostile input; tests and callers may set their own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # Sizes in bytes, then counts.
    body_bytes: int = 96 * 1024 * 1024
    inflated_bytes: int = 96 * 1024 * 1024
    sniff_bytes: int = 128 * 1024
    tabular_bytes: int = 32 * 1024 * 1024
    unzipped_bytes: int = 256 * 1024 * 1024
    rows: int = 200_000
    columns: int = 4_096
    cell_chars: int = 32_768
    zip_entries: int = 4_096
    shared_strings: int = 1_000_000


DEFAULT = Limits()
