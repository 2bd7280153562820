"""Set-based operators over article, claim and triple tables."""
