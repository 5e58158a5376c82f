"""Plan construction over metapaths and schemas; names only, no data."""
