"""End-to-end plans: build the market, score it, and the analyst views."""
