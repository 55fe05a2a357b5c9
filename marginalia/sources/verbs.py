"""File verbs (A3, A11-A15): small driver operations inside one vault."""

from __future__ import annotations

from pathlib import Path

from marginalia.sources.vault import inside, vault_root


class Vault:
    """One vault on a file system. Every path is relative, and none may leave the folder."""

    def __init__(self, root: str):
        self.root: Path = vault_root(root)

    def rel(self, path: Path) -> str:
        return path.resolve().relative_to(self.root).as_posix()

    def exists(self, rel: str) -> bool:
        try:
            return inside(self.root, rel).exists()
        except ValueError:
            return False

    def read_text(self, rel: str) -> str:
        return inside(self.root, rel).read_text(encoding="utf-8")

    def write_text(self, rel: str, text: str) -> None:
        target = inside(self.root, rel)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")

    def list_dir(self, rel: str = "") -> list[str]:
        return sorted(p.name + "/" * p.is_dir() for p in inside(self.root, rel).iterdir())

    def view(self, rel: str, lines: tuple[int, int] | None = None) -> str:
        """A folder's listing, a file, or the lines ``first..last`` of it (from 1, both included)."""
        target = inside(self.root, rel)
        if target.is_dir():
            return "\n".join(self.list_dir(rel))
        text = target.read_text(encoding="utf-8")
        return text if lines is None else "\n".join(text.splitlines()[lines[0] - 1 : lines[1]])

    def create(self, rel: str, text: str) -> str:
        """A12."""
        verb = "overwrote" if self.exists(rel) else "created"
        self.write_text(rel, text)
        return f"{verb} {rel} ({len(text)} characters)"

    def str_replace(self, rel: str, old: str, new: str) -> str:
        """``old`` must occur exactly once."""
        text = self.read_text(rel)
        n = text.count(old) if old else 0
        if n != 1:
            raise ValueError(f"{n} occurrences in {rel}, one is needed")
        self.write_text(rel, text.replace(old, new))
        return f"replaced in {rel}"

    def insert(self, rel: str, line: int, text: str) -> str:
        """Insert after line ``line``; 0 puts the text first."""
        rows = self.read_text(rel).splitlines(keepends=True)
        if not 0 <= line <= len(rows):
            raise ValueError(f"line {line} is not in 0..{len(rows)}")
        if line and rows and not rows[line - 1].endswith("\n"):
            rows[line - 1] += "\n"
        rows.insert(line, text if text.endswith("\n") else text + "\n")
        self.write_text(rel, "".join(rows))
        return f"inserted into {rel} after line {line}"

    def delete(self, rel: str) -> str:
        """A file, or a folder that is empty."""
        target = inside(self.root, rel)
        if target == self.root:
            raise ValueError("the vault itself stays")
        target.rmdir() if target.is_dir() else target.unlink()
        return f"deleted {rel}"
