"""Deterministic stand-ins for the text model, used by queries and tests."""

from __future__ import annotations

import re

from docflow.plans.extract import Request, Result

_ASSET = re.compile(r"asset/(01AB|lower)(\d+)(/medium)?")
_TITLE = re.compile(r"<title>([^<]*)</title>")

DOWNLOAD = "400 Failed to download image"
LIMITED = "429 Too Many Requests"
TIMEOUT = "503 upstream timeout"
FORMAT = "Invalid image format"


def _page_error(request: Request) -> str | None:
    found = _ASSET.search(request.url)
    if not found:
        return None
    kind, number, medium = found.group(1), int(found.group(2)), found.group(3)
    if kind == "lower":
        if number % 9 == 0 or (number % 9 == 1 and request.seq == 1):
            return TIMEOUT
        return None
    if number % 7 == 0:
        return FORMAT
    if number % 3 == 0 and medium:
        return DOWNLOAD
    if number % 3 == 0 and number % 5 == 0 and request.seq < 3:
        return LIMITED
    return None


def title_model():
    """Title of the page in the payload; errors follow from the address.

    A page that was read is charged by its characters, also if its format was refused.
    """

    def call(requests: list[Request]) -> list[Result]:
        results = []
        for request in requests:
            error = _page_error(request)
            read = len(request.payload or "")
            if error:
                results.append(Result(error=error, prompt_tokens=read if error == FORMAT else 0))
                continue
            found = _TITLE.search(request.payload or "")
            text = found.group(1) if found else ""
            results.append(
                Result(text, len(text), prompt_tokens=read, completion_tokens=len(text))
            )
        return results

    return call


def letter_model():
    """Counts the letter e of the payload."""

    def call(requests: list[Request]) -> list[Result]:
        return [Result(text=str(r.payload.count("e")), tokens=len(r.payload)) for r in requests]

    return call


def asset_model():
    """Text made from the asset number; some numbers always fail."""

    def call(requests: list[Request]) -> list[Result]:
        results = []
        for request in requests:
            number = int(_ASSET.search(request.url).group(2))
            if number % 3 == 0:
                results.append(Result(error=FORMAT))
            elif number % 7 == 0:
                results.append(Result(error=TIMEOUT))
            else:
                results.append(Result(text=f"words of {number}", tokens=3))
        return results

    return call
