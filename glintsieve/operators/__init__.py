"""Detection as DataFrame transformations: lines, candidates, findings, groups."""
