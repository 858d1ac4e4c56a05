"""Settings of a run in a properties file, with a default for each."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from filelake.functions.fixed import FOLDER_PATTERNS, IGNORE_PATTERNS

# Duplicate policies.
POLICIES = ["SKIP", "MOVE_TO_BUCKET", "KEEP_BOTH"]


@dataclass
class Settings:
    """``threads`` 0 in a file means twice the cores; an unknown pattern or policy falls back to its default; a number that
    isn't one is an error. Keys that are not known here are kept and written back."""

    threads: int = 0
    image_min_kb: int = 10
    video_min_kb: int = 100
    high_priority: bool = False
    deep_validation: bool = True
    dark_mode: bool = False
    folder_pattern: str = "YYYY_MMM"
    duplicate_policy: str = "SKIP"
    user_ignore: list[str] = field(default_factory=list)
    other: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.threads <= 0:
            self.threads = 2 * (os.cpu_count() or 1)

    @property
    def ignore(self) -> list[str]:
        return [*IGNORE_PATTERNS, *self.user_ignore]


# The key of each setting in a properties file.
KEYS = {
    "threads": "worker.thread.count", "image_min_kb": "validation.image.min.kb", "video_min_kb": "validation.video.min.kb", "high_priority": "performance.high.priority",
    "deep_validation": "validation.deep.enabled", "dark_mode": "ui.dark.mode", "folder_pattern": "folder.pattern", "duplicate_policy": "duplicate.policy", "user_ignore": "ignore.patterns.user",
}


def read_properties(path: str) -> dict[str, str]:
    """``key=value`` or ``key: value`` lines; # and ! begin comments, a final backslash joins lines. No file: no keys."""
    found: dict[str, str] = {}
    if not os.path.exists(path):
        return found
    with open(path, encoding="utf-8") as f:
        lines = iter(f.read().splitlines())
    for line in lines:
        line = line.lstrip()
        if not line or line[0] in "#!":
            continue
        while (len(line) - len(line.rstrip("\\"))) % 2:
            line = line[:-1] + next(lines, "").lstrip()
        cut = next((i for i, c in enumerate(line) if c in "=:" and line[i - 1 : i] != "\\"), len(line))
        clean = lambda x: x.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\")
        found[clean(line[:cut].strip())] = clean(line[cut + 1 :].lstrip())
    return found


def load(path: str) -> Settings:
    raw = read_properties(path)
    s = Settings()
    for name, key in KEYS.items():
        if key not in raw:
            continue
        text, now = raw.pop(key), getattr(s, name)
        if isinstance(now, bool):
            setattr(s, name, text.strip().lower() == "true")
        elif isinstance(now, int):
            setattr(s, name, int(text))
        elif isinstance(now, list):
            s.user_ignore = [p for x in text.split(",") if (p := x.strip())]
        elif text in (FOLDER_PATTERNS if name == "folder_pattern" else POLICIES):
            setattr(s, name, text)
    s.other = raw
    s.__post_init__()
    return s


def save(s: Settings, path: str) -> None:
    escaped = lambda x: x.replace("\\", "\\\\").replace("=", "\\=").replace(":", "\\:")
    shown = lambda v: str(v).lower() if isinstance(v, bool) else ",".join(v) if isinstance(v, list) else str(v)
    rows = s.other | {key: shown(getattr(s, name)) for name, key in KEYS.items()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{escaped(k)}={v.replace(chr(92), chr(92) * 2)}\n" for k, v in rows.items())
