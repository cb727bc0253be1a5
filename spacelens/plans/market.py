"""Build the market: facts -> dictionaries and cells -> company sums -> enriched spaces."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from spacelens.config import LinkConfig, ScoreConfig
from spacelens.operators import spaces as sp
from spacelens.operators.competition import add_competition_metrics
from spacelens.operators.growth import add_growth_metrics, market_totals
from spacelens.operators.linking import add_trend_multiplier, neutral_trend, signal_links
from spacelens.operators.rightowin import add_right_to_win_metrics, space_molecules, write_reach
from spacelens.operators.scoring import build_scorecard
from spacelens.sources.stage import stage


@dataclass
class Market:
    """Lazy tables of one market.

    The fact table is scanned once, to sum it to cells. Dictionaries, cells, (space, company) sums
    and every table that several later steps read are written once and read back.
    """

    cells: DataFrame
    articles: DataFrame
    signals: DataFrame | None = None
    score: ScoreConfig = ScoreConfig()
    link: LinkConfig = LinkConfig()

    @classmethod
    def build(
        cls,
        facts: DataFrame,
        focal_company: str,
        signals: DataFrame | None = None,
        score: ScoreConfig = ScoreConfig(),
        link: LinkConfig = LinkConfig(),
    ) -> "Market":
        sums = stage(sp.pack_sums(facts), "pack_sums")
        articles = stage(sp.articles(sums), "articles")
        cells = sp.cells(sums, articles, stage(sp.brands(sums), "brands"), focal_company)
        return cls(stage(cells, "cells"), articles, signals, score, link)

    @cached_property
    def named_cells(self) -> DataFrame:
        """The cells with their article's texts and ingredients."""
        return self.cells.join(self.articles.drop("spaces"), "article").drop("article")

    @cached_property
    def space_names(self) -> DataFrame:
        return stage(sp.space_names(self.articles), "space_names")

    @cached_property
    def article_spaces(self) -> DataFrame:
        return stage(sp.article_spaces(self.articles, self.space_names), "article_spaces")

    @cached_property
    def article_companies(self) -> DataFrame:
        return stage(sp.article_companies(self.cells), "article_companies")

    @cached_property
    def article_values(self) -> DataFrame:
        return stage(sp.article_values(self.article_companies, self.articles), "article_values")

    @cached_property
    def companies(self) -> DataFrame:
        sums = sp.company_cells(self.article_companies, self.article_spaces, self.space_names)
        return stage(sums, "company_cells")

    @cached_property
    def space_facts(self) -> DataFrame:
        context = sp.space_context(self.article_values, self.article_spaces, self.space_names)
        return stage(sp.space_facts(self.companies, context), "space_facts")

    @cached_property
    def company_facts(self) -> DataFrame:
        return stage(sp.company_facts(self.companies, self.space_facts), "company_facts")

    @cached_property
    def brand_facts(self) -> DataFrame:
        return stage(sp.brand_facts(self.cells, self.article_spaces, self.space_names), "brand_facts")

    @cached_property
    def molecules(self) -> DataFrame:
        found = space_molecules(self.article_values, self.article_spaces, self.space_names)
        return stage(found, "space_molecules")

    @cached_property
    def grown(self) -> DataFrame:
        return add_growth_metrics(self.space_facts)

    @cached_property
    def totals(self) -> DataFrame:
        return market_totals(self.space_facts)

    @cached_property
    def links(self) -> DataFrame:
        if self.signals is None:
            raise ValueError("this market has no signals")
        return stage(
            signal_links(self.space_facts, self.signals, self.molecules, self.link), "links"
        )

    def write_facts(self) -> None:
        """Write the space, company, brand and molecule tables now."""
        for name in ("space_facts", "company_facts", "brand_facts", "molecules"):
            getattr(self, name)

    @cached_property
    def reach(self) -> dict[str, DataFrame]:
        return write_reach(self.named_cells, self.article_values)

    @cached_property
    def enriched(self) -> DataFrame:
        """Spaces with growth, competition, right to win and the trend multiplier."""
        out = add_competition_metrics(self.grown, self.company_facts)
        articles = (self.article_values, self.article_spaces, self.space_names)
        out = add_right_to_win_metrics(out, *articles, self.molecules, self.reach)
        if self.signals is None:
            out = neutral_trend(out)
        else:
            out = add_trend_multiplier(out, self.links, self.link)
        return stage(out, "enriched")

    def scorecard(self, score: ScoreConfig | None = None, levels: list[str] | None = None):
        """(scored, excluded)."""
        return build_scorecard(self.enriched, score or self.score, levels)

    @cached_property
    def scored(self) -> DataFrame:
        """The scored spaces under the market's own configuration, written once."""
        return stage(self.scorecard()[0], "scored")
