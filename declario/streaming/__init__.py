"""Row-wise operators on streams. Mappings, casts and row rules are columns, so a
streaming frame takes them as it is; these helpers add what a stream needs."""
