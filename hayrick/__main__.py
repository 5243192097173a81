from hayrick.cli import main

main()
