"""phasemill: DataFrame operators for folded time series and signal catalogues."""
