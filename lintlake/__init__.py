"""lintlake: code-quality analytics over tables of repositories, files, findings and logs."""
