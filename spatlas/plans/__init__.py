"""Whole jobs: grid audit, interpretation of results, runners, benchmarks and the registered queries."""
