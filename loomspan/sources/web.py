"""Pages of the web, rendered by a browser as PDF or kept as HTML."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.interfaces import Fetcher
from loomspan.sources.files import download

MODES = ("pdf", "html")


class Browser:
    """``get`` of a URL by the package ``playwright``: a page printed as PDF, or its HTML after scripts ran.

    A worker process starts its browser at its first page. ``wait_for="networkidle"`` waits up to 5 seconds for the network to
    calm down after the page has come; pages that never do are taken as they are then.
    """

    def __init__(self, mode: str = "pdf", wait_for: str | None = "networkidle", headless: bool = True, timeout: float = 30):
        self.mode, self.wait_for, self.headless, self.timeout = mode, wait_for, headless, timeout
        self._context = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_context": None}

    def context(self) -> object:
        if self._context is None:
            try:
                from playwright.sync_api import sync_playwright
            except ImportError as e:
                raise ImportError("the package playwright isn't installed; give get= instead") from e
            browser = sync_playwright().start().chromium.launch(headless=self.headless)
            self._context = browser.new_context(viewport={"width": 1440, "height": 900}, ignore_https_errors=True)
        return self._context

    def __call__(self, url: str) -> bytes:
        page = self.context().new_page()
        try:
            page.goto(url, wait_until="load", timeout=self.timeout * 1000)
            if self.wait_for:
                try:
                    page.wait_for_load_state(self.wait_for, timeout=5000)
                except Exception:  # noqa: BLE001, S110: a page that stays busy is taken as it is
                    pass
            if self.mode == "pdf":
                page.emulate_media(media="screen")
                return page.pdf(format="A4", print_background=True)
            return page.content().encode()
        finally:
            page.close()


class WebFetcher(Fetcher):
    """URLs, stored in a shared folder as PDF or HTML. ``get(url)`` gives the bytes; by default a browser does."""

    def __init__(self, folder: str, mode: str = "pdf", get: Callable[[str], bytes] | None = None, wait_for: str | None = "networkidle", headless: bool = True):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.folder, self.mode, self.get = folder, mode, get or Browser(mode, wait_for, headless)

    def fetch(self, spark: SparkSession, path: str | None = None, folder: str | None = None, urls: list[str] | None = None, **options: object) -> DataFrame:
        """One URL as ``path``, or many; those that fail are left out."""
        wanted = [*(urls or []), *([path] if path and path.startswith("http") else [])]
        if not wanted:
            raise ValueError("give at least one URL, as path or urls")
        os.makedirs(self.folder, exist_ok=True)
        return download(spark, wanted, self.get, self.folder, self.mode)
