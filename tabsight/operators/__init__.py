"""DataFrame -> DataFrame operators (statistics, types, quality, roles, charts)."""
