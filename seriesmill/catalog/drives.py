"""Hard drive health columns and the published column sets."""

from __future__ import annotations

from seriesmill.session import as_list

# Ids of the health attributes in each named set.
RAW_SETS = {
    "microsoft": (1, 4, 5, 7, 9, 12, 187, 193, 194, 197, 199),
    "tencent": (1, 3, 5, 7, 9, 10, 12, 187, 192, 194, 196, 197, 198),
    "backblaze": (5, 187, 188, 197, 198),
    "custom0": (5, 7, 184, 187, 188, 9, 4, 12, 193, 194),
}
RAW_AND_NORMALIZED_SETS = {
    "paper": (1, 3, 4, 5, 7, 9, 10, 12, 187, 189, 192, 193, 194, 195, 197, 198, 199),
}
ALL_IDS = range(1, 256)


def preset_columns(features: str | list[str]) -> list[str]:
    """Union of named sets and single column names, sorted and without duplicates."""
    chosen: set[str] = set()
    for name in as_list(features):
        raw, normalized = (), ()
        if name in RAW_SETS:
            raw = RAW_SETS[name]
        elif name in RAW_AND_NORMALIZED_SETS:
            raw = normalized = RAW_AND_NORMALIZED_SETS[name]
        elif name in ("all", "all_raw", "all_normalized"):
            raw = ALL_IDS if name != "all_normalized" else ()
            normalized = ALL_IDS if name != "all_raw" else ()
        else:
            chosen.add(name)
        chosen.update(f"smart_{i}_raw" for i in raw)
        chosen.update(f"smart_{i}_normalized" for i in normalized)
    return sorted(chosen)
