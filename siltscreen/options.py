"""Options shared by the text and the HTML path."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SanitizeOptions:
    allow_data_uris: bool = False
    #: Longest text, in characters, that a base64 run may stand for to be decoded; None decodes every run.
    max_base64_decode_length: int | None = None
    custom_patterns: tuple[str, ...] = ()
    #: Open bold, italics, links and the like anew after a block that ended before them, as a browser does.
    reopen_formatting: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "custom_patterns", tuple(self.custom_patterns))
        if any(p == "" for p in self.custom_patterns):
            raise ValueError("a custom pattern must not be empty")

    @property
    def max_base64_run(self) -> float | None:
        """Longest base64 run, in characters, that is still decoded; None without a limit."""
        return None if self.max_base64_decode_length is None else self.max_base64_decode_length * 1.4
