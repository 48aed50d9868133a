"""DataFrame operators: normalisation, candidates, matching, scoring, tax, policy."""
